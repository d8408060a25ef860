"""Answer scoring: one expression per task type over prediction and answer text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollframe.functions import geometry as G
from rollframe.functions import text as X
from rollframe.operators import maps as M


def _num(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


def token_sequence(pred: Column, answer: Column) -> Column:
    """Same items in the same order, blanks and case aside."""
    clean = lambda a: F.transform(X.extract_sequence(a), lambda t: F.lower(X.squeeze(t)))
    return _num(clean(pred) == clean(answer))


def _direction_distance(text: Column) -> Column:
    """(direction, distance) from a list, from lines or semicolons, or from the last word."""
    pieces = F.filter(F.transform(F.split(text, r"[;\n]"), X.strip), lambda s: s != "")
    words = F.filter(F.transform(F.split(text, r"[ ,]"), X.strip), lambda s: s != "")
    last = lambda w: F.array(F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " "), F.try_element_at(w, F.lit(-1)))
    pair = X.let(X.extract_sequence(text), lambda items: F.when(F.size(items) >= 2, F.slice(items, 1, 2)).otherwise(
        X.let(pieces, lambda p: F.when(F.size(p) >= 2, F.slice(p, 1, 2)).otherwise(
            X.let(words, lambda w: F.when(F.size(w) >= 2, last(w)))))))
    return F.transform(pair, X.canonical_label)


def direction_text(pred: Column, answer: Column) -> Column:
    """Half a point each for direction and distance, in either order."""
    def best(p: Column, a: Column) -> Column:
        same = lambda i, j: F.when((p[i] != "") & (p[i] == a[j]), 0.5).otherwise(0.0)
        return F.when(p.isNotNull() & a.isNotNull(), F.greatest(same(0, 0) + same(1, 1), same(1, 0) + same(0, 1)))
    both = F.struct(_direction_distance(pred).alias("p"), _direction_distance(answer).alias("a"))
    return F.coalesce(X.let(both, lambda z: best(z["p"], z["a"])), F.lit(0.0))


def label(pred: Column, answer: Column) -> Column:
    return _num(X.labels_match(pred, answer))


def multiple_choice(pred: Column, answers: Column) -> Column:
    said = F.lower(X.strip(pred))
    return _num((said != "") & F.array_contains(F.transform(answers, F.lower), said))


def text_sequence(pred: Column, expected: Column) -> Column:
    return _num(F.transform(X.extract_sequence(pred), F.lower) == F.transform(expected, F.lower))


def degree_sequence(pred: Column, expected: Column) -> Column:
    return _num(X.extract_sequence(pred, "int", "(?i)[°degrees\\s]") == expected.cast("array<int>"))


def object_presence(pred: Column, answers: Column) -> Column:
    """F1 of the named objects."""
    p, a = F.array_distinct(F.transform(X.extract_sequence(pred), F.lower)), F.array_distinct(F.transform(answers, F.lower))
    hit = F.size(F.array_intersect(p, a)).cast("double")
    return F.coalesce(F.when(p.isNotNull() & (F.size(p) + F.size(a) > 0), 2 * hit / (F.size(p) + F.size(a))), F.lit(0.0))


def coordinates(text: Column) -> Column:
    """All ``x, y`` pairs in a text."""
    number = r"-?\d+(?:\.\d+)?"
    found = F.regexp_extract_all(text, F.lit(rf"({number}\s*,\s*{number})"), 1)
    return F.transform(found, lambda t: F.struct(
        X.strip(F.split(t, ",")[0]).cast("double").alias("x"), X.strip(F.split(t, ",")[1]).cast("double").alias("y")))


def location(pred: Column, x: Column, y: Column, use_accuracy: bool = False) -> Column:
    """Similarity of the first predicted coordinate."""
    p = F.try_element_at(coordinates(pred), F.lit(1))
    s = F.when(p.isNotNull(), G.coordinate_similarity(p["x"], p["y"], x, y)).otherwise(0.0)
    return G.relative_accuracy(s) if use_accuracy else s


def coordinate_set(pred: Column, truth: Column, norm: Column | None = None) -> Column:
    """Mean of position and direction similarity of listed points, matched by place in the list."""
    points = coordinates(pred)
    matched = F.transform(truth, lambda g, i: F.struct(g.alias("g"), F.try_element_at(points, i + 1).alias("p")))
    both = X.let(matched, lambda m: M.coordinate_similarity_of(m, norm))
    return F.when((F.size(points) > 0) & (F.size(points) == F.size(truth)), both).otherwise(0.0)


def numbered_directions(pred: Column, expected: Column) -> Column:
    """A numbered list of sequences, right only if every expected line is right."""
    lines = F.transform(F.split(pred, r"\r?\n"), X.strip)
    parsed = F.filter(F.transform(lines, lambda s: F.struct(
        (F.regexp_extract(s, r"^\s*(\d+)\s*\. ", 1).try_cast("int")).alias("i"), F.regexp_extract(s, r"^\s*\d+\s*\. (.*)$", 1).alias("t"))), lambda z: z["i"].isNotNull())
    right = F.filter(parsed, lambda z: (z["i"] >= 1) & (z["i"] <= F.size(expected)) & (
        text_sequence(z["t"], F.try_element_at(expected, z["i"])) == 1.0))
    return _num(F.size(right) == F.size(expected))


def location_text(pred: Column, answer: Column) -> Column:
    """:func:`location` with the true coordinate given as text."""
    return X.let(F.try_element_at(coordinates(answer), F.lit(1)), lambda c: F.when(
        c.isNotNull(), location(pred, c["x"], c["y"])).otherwise(0.0))


def coordinate_set_text(pred: Column, answer: Column) -> Column:
    return coordinate_set(pred, coordinates(answer))


# Fixed value: fields of a view answer.
VIEW = ("answer STRING, room_id STRING, object_positions MAP<STRING, ARRAY<DOUBLE>>, object_orientations MAP<STRING, ARRAY<DOUBLE>>, object_rooms MAP<STRING, STRING>, "
        "final_observation ARRAY<STRUCT<name: STRING, direction: STRING, distance: STRING, orientation: STRING>>, "
        "gate_info MAP<STRING, STRUCT<room_ids: STRING, ori_by_room: MAP<STRING, ARRAY<DOUBLE>>>>")
# Cosine of half the field of view with its slack; walls by where a gate faces.
IN_VIEW = 0.707 - 1e-3
WALLS = {"forward": "on back wall", "backward": "on front wall", "left": "on right wall", "right": "on left wall"}


def _named(entries: Column, name: Column) -> Column:
    """The value under a name, whatever the case of the key; null if there is none."""
    return F.try_element_at(F.filter(F.map_entries(entries), lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]


def _heading(v: Column) -> Column:
    """One of the eight headings; none at all counts as north."""
    flat = (F.abs(v[0]) <= 1e-8) & (F.abs(v[1]) <= 1e-8)
    return F.when(v.isNull() | flat, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.signum(v[0]), F.signum(v[1])))


def _rooms(text: Column) -> Column:
    """Room numbers of a number or a list of them."""
    return F.regexp_extract_all(text, F.lit(r"(-?\d+)"), 1)


def _faces(view: Column, name: Column, own: Column, at: Column) -> Column:
    """How an object is turned, seen with heading ``at``: a gate by its wall, from the one room it shares with the viewer."""
    gate = F.try_element_at(view["gate_info"], name)
    shared = F.array_intersect(_rooms(gate["room_ids"]), _rooms(view["room_id"]))
    turned = F.when(F.size(shared) == 1, F.coalesce(F.try_element_at(gate["ori_by_room"], F.try_element_at(shared, F.lit(1))), own)).otherwise(own)
    wall = F.create_map(*[F.lit(x) for pair in WALLS.items() for x in pair])
    seen = lambda v: G.relative_orientation(v[0], v[1], at[0], at[1])
    return F.when(gate.isNotNull(), F.try_element_at(wall, X.let(turned, seen))).otherwise(F.concat(F.lit("facing "), seen(own)))


def _sees(view: Column, at: Column, heading: Column, item: Column) -> Column:
    """Is one observed object where and how the observation says, from this place?"""
    name = F.lower(X.strip(item["name"]))

    def check(found: Column) -> Column:
        dx, dy = found["at"][0] - at[0], found["at"][1] - at[1]
        close = lambda d, t: F.abs(d) <= 1e-8 + 1e-5 * F.abs(t)
        apart = ~(close(dx, found["at"][0]) & close(dy, found["at"][1]))
        rooms = view["room_id"].isNull() | found["room"].isNull() | F.arrays_overlap(_rooms(view["room_id"]), _rooms(found["room"]))
        ahead = (dx * heading[0] + dy * heading[1]) / (G.distance(dx, dy) * G.distance(heading[0], heading[1])) >= IN_VIEW
        placed = (X.canonical_label(G.front_bin(G.bearing(dx, dy, heading[0], heading[1]))) == X.canonical_label(item["direction"])) & (
            X.canonical_label(G.distance_bin(G.distance(dx, dy))) == X.canonical_label(item["distance"]))
        turned = (F.coalesce(item["orientation"], F.lit("")) == "") | found["faces"].isNull() | (
            X.canonical_label(_faces(view, name, _heading(found["faces"]), heading)) == X.canonical_label(item["orientation"]))
        return F.coalesce(found["at"].isNotNull() & apart & rooms & ahead & placed & turned, F.lit(False))
    return X.let(F.struct(_named(view["object_positions"], name).alias("at"), _named(view["object_orientations"], name).alias("faces"),
                          F.try_element_at(view["object_rooms"], name).alias("room")), check)


def backward_view(pred: Column, answer: Column) -> Column:
    """The named object is the right one, or what was observed can be seen from it.

    The answer is a JSON object with the room and the observation; any other answer is a label.
    An object that is not in the room scores nothing. An empty observation is an error.
    """
    said = F.lower(X.strip(pred))

    def from_object(view: Column) -> Column:
        filled = F.filter(view["final_observation"], lambda o: (X.strip(F.coalesce(o["name"], F.lit(""))) != "")
                          & (X.canonical_label(o["direction"]) != "") & (X.canonical_label(o["distance"]) != ""))
        # Of several entries of one name the last counts.
        last = F.filter(filled, lambda o, i: ~F.exists(F.slice(filled, i + 2, F.size(filled)), lambda p: F.lower(X.strip(p["name"])) == F.lower(X.strip(o["name"]))))
        none = F.when(F.coalesce(F.size(view["final_observation"]), F.lit(0)) <= 0,
                      F.raise_error(F.lit("final_observation is empty")).cast("boolean"))

        def from_place(place: Column) -> Column:
            seen = F.forall(last, lambda o: _sees(view, place["at"], place["heading"], o))
            return F.when(place["at"].isNull(), 0.0).otherwise(_num(F.coalesce(none, F.lit(False)) | X.labels_match(pred, view["answer"]) | seen))
        return X.let(F.struct(_named(view["object_positions"], said).alias("at"), _heading(_named(view["object_orientations"], said)).alias("heading")), from_place)
    is_object = X.strip(answer).startswith("{") & F.try_parse_json(answer).isNotNull()
    return F.when(is_object, X.let(F.from_json(answer, VIEW), from_object)).otherwise(label(pred, answer))


# The evaluator table: task type to the expression over (prediction, answer) text. Users
# add their own entries; a pandas UDF column works as well.
EVALUATORS = {
    "RotEvaluationTask": token_sequence,
    "DirectionEvaluationTask": direction_text,
    "PovEvaluationTask": direction_text,
    "DirectionPov": direction_text,
    "FalseBeliefDirectionPov": direction_text,
    "Action2ViewEvaluationTask": direction_text,
    "Location2ViewEvaluationTask": direction_text,
    "BackwardPovTextEvaluationTask": backward_view,
    "BackwardPovVisionEvaluationTask": label,
    "View2LocationTextEvaluationTask": location_text,
    "View2LocationVisionEvaluationTask": location_text,
    "AlloMappingEvaluationTask": coordinate_set_text,
}


def score(task: Column, pred: Column, answer: Column, evaluators: dict | None = None) -> Column:
    """Score by task type; a task without an evaluator is an error."""
    out = None
    for name, fn in (evaluators or EVALUATORS).items():
        value = fn(pred, answer)
        out = F.when(task == name, value) if out is None else out.when(task == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown task evaluator: "), F.coalesce(task, F.lit("null")))).cast("double"))
