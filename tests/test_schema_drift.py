import json

import numpy as np

from plenarium.operators import schema_drift as sd

SCHEMA = "line_id long, series string, task string, run_no int, line_no int, record_key string, body string, kind string, object string"


def lines(spark, files, task="t"):
    out, n = [], 0
    for run, rows in files.items():
        for i, (key, body) in enumerate(rows):
            n += 1
            out.append((n, "s", task, run, i, key, body if body is None or isinstance(body, str) else json.dumps(body), "clash", "clash"))
    return spark.createDataFrame(out, SCHEMA)


def changed(spark, files):
    return {(r["run_no"], r["change_kind"], r["field_old"], r["field_new"]) for r in sd.drift(lines(spark, files)).collect()}


def recs(n, f):
    return [(f"k{i}", f(i)) for i in range(n)]


def test_all_kinds(spark):
    files = {
        1: recs(6, lambda i: {"a": i, "frame": f"x{i}", "old": 1}),
        3: recs(6, lambda i: {"a": str(i), "dominant_frame": f"x{i}", "new": True}),
        4: recs(6, lambda i: {"a": str(i), "dominant_frame": f"x{i}", "new": [1]}),
    }
    assert changed(spark, files) == {(3, "renamed", "frame", "dominant_frame"), (3, "removed", "old", ""), (3, "added", "", "new"), (3, "type_changed", "a", "a"), (4, "type_changed", "new", "new")}


def test_renaming_needs_two_thirds(spark):
    old = recs(6, lambda i: {"f": f"x{i}"})
    assert (2, "renamed", "f", "g") in changed(spark, {1: old, 2: recs(6, lambda i: {"g": f"x{i}" if i < 4 else "other"})})
    assert changed(spark, {1: old, 2: recs(6, lambda i: {"g": f"x{i}" if i < 3 else "other"})}) == {(2, "removed", "f", ""), (2, "added", "", "g")}


def test_nulls_do_not_count_but_make_a_field(spark):
    files = {1: recs(4, lambda i: {"f": f"x{i}", "n": None}), 2: recs(4, lambda i: {"g": f"x{i}" if i < 2 else None, "n": None})}
    assert changed(spark, files) == {(2, "renamed", "f", "g")}


def test_unreadable_and_wrapped_lines(spark):
    files = {
        1: [("a", '```json\n{"f": 1}\n```'), ("b", 'Here it is: {"f": 2}'), ("c", '{"broken": "x'), ("d", None), ("e", "[1, 2]"), ("f", ""), ("g", '{"f": 3} {"h": 1}')],
        2: [("a", {"f": 1.0}), ("a", {"f": 1.0}), (None, {"f": 5})],
    }
    assert changed(spark, files) == set()


def test_single_file_and_empty(spark):
    assert changed(spark, {1: recs(3, lambda i: {"f": i})}) == set()
    assert sd.drift(lines(spark, {})).count() == 0
    assert sd.unified(lines(spark, {})).count() == 0


def test_missing_file_keys_are_no_file(spark):
    df = spark.createDataFrame([(1, None, "t", 1, 1, "k", '{"a": 1}', "", ""), (2, "s", "t", None, 1, "k", '{"b": 1}', "", "")], SCHEMA)
    assert sd.drift(df).count() == 0


def test_values_that_are_lists_and_objects(spark):
    files = {1: recs(3, lambda i: {"f": [i], "usage": {"x": i}}), 2: recs(3, lambda i: {"g": [i], "used": {"x": i}})}
    assert changed(spark, files) == {(2, "renamed", "f", "g"), (2, "renamed", "usage", "used")}


def test_unified_has_one_name_and_type_per_field(spark):
    files = {
        1: recs(3, lambda i: {"f": f"x{i}", "n": i, "tags": ["a", "b"], "o": {"p": 1}, "Task": True, "N": i}),
        2: recs(3, lambda i: {"g": f"x{i}", "n": i or "0", "tags": "c", "o": None, "Task": "maybe", "N": None}),
        3: recs(3, lambda i: {"g": f"x{i}", "n": "none"}),
    }
    got = sd.unified(lines(spark, files))
    assert dict(got.dtypes) == {
        "line_id": "bigint", "series": "string", "task": "string", "run_no": "int", "record_key": "string", "uncast": "map<string,string>",
        "g": "string", "n_2": "double", "N": "double", "tags": "array<string>", "o": "map<string,string>", "Task_2": "boolean",
    }
    rows = {(r["run_no"], r["record_key"]): r for r in got.collect()}
    assert len(rows) == 9 and {r["g"] for r in rows.values()} == {"x0", "x1", "x2"}
    assert rows[1, "k1"]["n_2"] == rows[2, "k1"]["n_2"] == rows[1, "k1"]["N"] == 1.0 and rows[2, "k1"]["N"] is None
    assert rows[1, "k0"]["tags"] == ["a", "b"] and rows[2, "k0"]["tags"] == ["c"] and rows[3, "k0"]["tags"] is None
    assert rows[1, "k0"]["o"] == {"p": "1"} and rows[1, "k0"]["Task_2"] is True and rows[1, "k0"]["uncast"] is None
    assert rows[2, "k0"]["uncast"] == {"Task_2": '"maybe"'} and rows[3, "k0"]["uncast"] == {"n_2": '"none"'}


def test_flooding_decides(spark, monkeypatch):
    files = {1: recs(6, lambda i: {"frame": f"x{i}", "k": 1}), 2: recs(6, lambda i: {"main_frame": f"x{i}", "k": 1})}
    assert changed(spark, files) == {(2, "renamed", "frame", "main_frame")}
    monkeypatch.setattr(sd, "flood", lambda old, new: np.zeros((len(old["field"]), len(new["field"]))))
    assert changed(spark, files) == {(2, "removed", "frame", ""), (2, "added", "", "main_frame")}


def test_renaming_goes_on_among_free_fields(spark):
    """The best pair takes its fields; the next best pair of the others is a renaming as well."""
    old = recs(20, lambda i: {"a_label": f"x{i}", "b_label": f"x{i}" if i < 18 else "-"})
    new = recs(20, lambda i: {"x_label": f"x{i}" if i < 19 else "+", "y_label": f"x{i}" if i < 16 else "="})
    assert changed(spark, {1: old, 2: new}) == {(2, "renamed", "a_label", "x_label"), (2, "renamed", "b_label", "y_label")}


def test_flooding_prefers_like_names_and_types():
    old = ({"field": ["dominant_frame", "confidence", "country"], "kind": ["string", "number", "string"], "nested": ["", "", ""]})
    new = ({"field": ["main_frame", "conf", "country"], "kind": ["string", "number", "string"], "nested": ["", "", ""]})
    s = sd.flood(old, new)
    assert s[0].argmax() == 0 and s[1].argmax() == 1 and s[2].argmax() == 2 and 0 < s.min() and s.max() == 1
