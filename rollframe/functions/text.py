"""Column expressions over response text: templates, actions, format audits, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The response formats. Each is a list of tags, joined by optional blanks;
# "*" stands for free text between tags.
ACTION_TAG_FORMATS = {
    "free_think": ["think", "action"],
    "wm": ["observation", "think", "action", "prediction"],
    "no_think": ["^", "action", "$"],
    "eval_mode": ["action"],
}
ANSWER_TAG_FORMATS = {
    "free_think": ["think", "answer"],
    "wm": ["observation", "think", "answer", "prediction"],
    "free_wm": ["observation", "*", "answer", "*", "prediction"],
}
# Per environment family its formats, action separator, most actions, lower-casing.
FAMILIES = {
    "navigation": (ACTION_TAG_FORMATS, "|", 5, True),
    "grid": (ANSWER_TAG_FORMATS, ",", 3, True),
    "skill": ({k: ANSWER_TAG_FORMATS[k] for k in ("free_think", "wm")}, "|", 2, False),
}
# Header labels of the plain-text answer style.
THINK_LABEL, ANSWER_LABEL = "THINK:", "FINAL ANSWER:"
# Image placeholder runs, most specific first.
IMAGE_RUNS = [
    r"<\|vision_start\|>(<\|image_pad\|>)+<\|vision_end\|>",
    r"(<\|image_pad\|>)+",
    r"(<\|imgpad\|>)+",
]
# Words that mark an error line, and the words that name an action.
ERROR_WORDS = ["error", "exception", "traceback", "failed", "invalid", "cannot", "timeout"]
ACTION_WORDS = ["up", "down", "left", "right", "forward", "backward", "turn"]
# Accepted spellings of direction and distance labels.
LABEL_ALIASES = {
    "front-left": ["front-left", "left-front", "front left", "left front", "frontleft", "leftfront", "fl"],
    "front-right": ["front-right", "right-front", "front right", "right front", "frontright", "rightfront", "fr"],
    "front-slight-left": ["front-slight-left", "front slightly left", "slightly front left", "frontslightleft", "slight front left"],
    "front-slight-right": ["front-slight-right", "front slightly right", "slightly front right", "frontslightright", "slight front right"],
    "mid distance": ["mid distance", "mid-distance", "mid", "medium", "medium distance"],
    "same distance": ["same distance", "same", "same-distance"],
    "slightly far": ["slightly far", "slightly-far"],
    "very far": ["very far", "very-far"],
    "extremely far": ["extremely far", "extremely-far", "extreme", "extreme far"],
    "north": ["north", "n"],
    "south": ["south", "s"],
    "east": ["east", "e"],
    "west": ["west", "w"],
    "north-east": ["north-east", "north east", "northeast", "ne"],
    "north-west": ["north-west", "north west", "northwest", "nw"],
    "south-east": ["south-east", "south east", "southeast", "se"],
    "south-west": ["south-west", "south west", "southwest", "sw"],
}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\s+", " ")


def normalize_template(text: Column) -> Column:
    """Lower-cased, blanks squeezed, numbers folded."""
    return F.regexp_replace(F.lower(squeeze(F.coalesce(text, F.lit("")))), r"\b\d+(?:\.\d+)?\b", "<number>")


def _tag_body(text: Column) -> Column:
    """Body of the first answer or action tag, else the whole text; an empty body stays empty."""
    pattern = r"(?is)<(answer|action)\b[^>]*>(.*?)</\1>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).otherwise(text)


def answer_template(text: Column) -> Column:
    return normalize_template(_tag_body(F.coalesce(text, F.lit(""))))


def normalized_action(text: Column) -> Column:
    return F.lower(squeeze(_tag_body(F.coalesce(text, F.lit("")))))


def _format_pattern(tags: list[str]) -> tuple[str, dict[str, int]]:
    parts, groups, free = [], {}, 0
    for tag in tags:
        if tag in "^$":
            parts.append(tag)
            continue
        name = tag
        if tag == "*":
            free += 1
            name, body = f"free{free}", "(.*?)"
        else:
            body = f"<{tag}>(.*?)</{tag}>"
        parts.append(body)
        groups[name] = len(groups) + 1
    return "(?s)" + ("" if "*" in tags else r"\s*").join(parts), groups


def parse_response(text: Column, family: str, response_format: str,
                   separator: str | None = None, max_actions: int | None = None) -> Column:
    """Struct of the sections, the action list and whether the format is correct."""
    formats, default_sep, default_max, lower = FAMILIES[family]
    if response_format not in formats:
        raise ValueError(f"unknown response format: {response_format}")
    pattern, groups = _format_pattern(formats[response_format])
    ok = F.coalesce(text.rlike(pattern), F.lit(False))

    def section(name: str) -> Column:
        if name not in groups:
            return F.lit(None).cast("string")
        return F.when(ok, strip(F.regexp_extract(text, pattern, groups[name])))

    action = section("action" if "action" in groups else "answer")
    pieces = F.transform(F.split(action, re.escape(separator or default_sep)), lambda a: strip(F.lower(a) if lower else a))
    actions = F.slice(F.filter(pieces, lambda a: a != ""), 1, max_actions or default_max)
    think = section("think")
    if "free1" in groups:
        think = F.when(ok, F.concat_ws(" ", F.filter(F.array(section("free1"), section("free2")), lambda p: p != "")))
    return F.struct(
        ok.alias("format_correct"), section("observation").alias("observation"), think.alias("think"),
        section("prediction").alias("prediction"), action.alias("action_text"),
        F.coalesce(actions, F.array().cast("array<string>")).alias("actions"))


def parse_headers(text: Column, with_think: bool = True) -> Column:
    """``THINK:`` / ``FINAL ANSWER:`` sections; falls back to tags, then to the whole text."""
    think_re = rf"(?is){re.escape(THINK_LABEL)}\s*(.*?)(?={re.escape(ANSWER_LABEL)}|\z)"
    answer_re = rf"(?is){re.escape(ANSWER_LABEL)}\s*(.*)\z"

    def found(pattern: str) -> Column:
        return F.nullif(strip(F.regexp_extract(text, pattern, 1)), F.lit(""))

    answer = F.coalesce(found(answer_re), found(r"(?is)<answer>(.*?)</answer>"), strip(text), F.lit(""))
    answer = strip(F.replace(F.replace(answer, F.lit("<|begin_of_box|>"), F.lit("")), F.lit("<|end_of_box|>"), F.lit("")))
    think = F.coalesce(found(think_re), found(r"(?is)<think>(.*?)</think>"), F.lit("")) if with_think else F.lit("")
    return F.struct(think.alias("think"), answer.alias("answer"), (answer != "").alias("parsed"))


def collapse_images(text: Column, replacement: str = "<image>") -> Column:
    for pattern in IMAGE_RUNS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def state_anchor(anchor: Column, remaining_turns: Column) -> Column:
    """Exact state key with the remaining turn budget."""
    budget = F.coalesce(F.greatest(remaining_turns.cast("long"), F.lit(0)).cast("string"), F.lit("unbounded"))
    budget = F.when(remaining_turns.isNull(), "unbounded").otherwise(budget)
    return F.concat(strip(anchor), F.lit("\n[remaining_turns="), budget, F.lit("]"))


def pose_anchor(horizon: Column, position: list[Column], rotation: list[Column], standing: Column) -> Column:
    """Canonical JSON of a pose, rounded half-even to four decimals."""
    def xyz(v: list[Column]) -> Column:
        return F.struct(*[F.bround(c, 4).alias(n) for c, n in zip(v, "xyz")])
    return F.to_json(F.struct(
        F.bround(horizon, 4).alias("camera_horizon"), xyz(position).alias("position"),
        xyz(rotation).alias("rotation"), F.coalesce(standing, F.lit(True)).alias("standing")))


def label_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s-]+", "")


def alias_pairs() -> list[tuple[str, str]]:
    """(spelling, canonical label), both as label keys."""
    def key(s: str) -> str:
        return re.sub(r"[\s-]+", "", s.lower())
    return sorted({(key(v), key(c)) for c, vs in LABEL_ALIASES.items() for v in [c, *vs]})


def canonical_label(text: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in alias_pairs() for x in pair])
    return let(label_key(text), lambda key: F.coalesce(F.try_element_at(lookup, key), key))


def labels_match(a: Column, b: Column) -> Column:
    return let(canonical_label(a), lambda ca: (ca != "") & (ca == canonical_label(b)))


def extract_sequence(text: Column, kind: str = "string", clean: str | None = None) -> Column:
    """Items of ``(...)``, ``[...]`` or comma text; null if there are none or one does not convert."""
    inner = F.when(text.rlike(r"\(.*?\)"), F.regexp_extract(text, r"\((.*?)\)", 1)).when(
        ~(text.contains("(") & text.contains(")")) & text.rlike(r"\[.*?\]"), F.regexp_extract(text, r"\[(.*?)\]", 1)).otherwise(text)
    items = F.filter(F.transform(F.split(inner, ","), lambda t: F.regexp_replace(strip(t), "^['\"]+|['\"]+$", "")), lambda t: t != "")
    if clean:
        items = F.transform(items, lambda t: F.regexp_replace(t, clean, ""))
    if kind != "string":
        items = F.transform(items, lambda t: t.try_cast(kind))
    return let(items, lambda a: F.when((F.size(a) > 0) & ~F.exists(a, lambda t: t.isNull()), a))


def error_pattern(line: Column) -> Column:
    """An error line with dates, numbers and paths folded, whole."""
    # What is folded, and the marks put in its place.
    folded = F.regexp_replace(F.lower(line), r"\d{4}-\d{2}-\d{2}", "")
    folded = F.regexp_replace(folded, r"\b\d+\b", "<N>")
    folded = F.regexp_replace(folded, r"/[^\s]+", "<PATH>")
    return strip(folded)


def action_word(text: Column, words: list[str] = ACTION_WORDS) -> Column:
    """The first listed word that occurs in the text, else ``unknown``."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(w), F.lit(w)) for w in words], F.lit("unknown"))


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
