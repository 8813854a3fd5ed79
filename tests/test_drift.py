from __future__ import annotations

import json

from lockgrain.functions.jsontext import canonical, kind_of, read_object
from lockgrain.operators import drift

SCHEMA = "lock_id long, source_path string, parsed_as string, rev int, content string, drift string"


def rows(*contents, path="p", parsed="package-lock"):
    return [(i, path, parsed, i + 1, c if c is None or isinstance(c, str) else json.dumps(c), "x") for i, c in enumerate(contents)]


def changes(spark, data):
    return sorted(tuple(r) for r in drift.schema_changes(spark.createDataFrame(data, SCHEMA)).collect())


def test_kinds_and_canonical():
    assert kind_of([1, "a", None]) == "array<null|number|string>" and kind_of(True) == "boolean" and kind_of([[1]]) == "array<array<number>>" and kind_of([]) == "array<>"
    assert canonical({"b": 1.0, "a": [2]}) == canonical({"a": [2], "b": 1}) and canonical(1) != canonical("1")
    assert read_object("﻿{}") == {} and read_object("[]") is None and read_object("{") is None and read_object(None) is None and read_object('{"a": NaN}') is None


def test_changes(spark):
    data = rows({"a": 1, "b": 2}, None, {"a": "1", "c": 2, "d": None}, "broken", {"a": "1", "d": [1]}, {"a": "1", "d": ["x"]})
    assert changes(spark, data) == [("p", 3, "renamed", "b", "c"), ("p", 3, "retyped", "a", "a"), ("p", 5, "added", "", "d"), ("p", 5, "removed", "c", ""), ("p", 6, "retyped", "d", "d")]


def test_equal_values_pair_one_to_one(spark):
    data = rows({"a": 1, "b": 1, "c": 1}, {"x": 1, "y": 1})
    assert changes(spark, data) == [("p", 2, "removed", "c", ""), ("p", 2, "renamed", "a", "x"), ("p", 2, "renamed", "b", "y")]


def test_loaded_twice_late_and_far_apart(spark):
    one = rows({"a": 1}, {"b": 2})
    data = one + [(9, *one[1][1:])] + [(20, "p", "package-lock", 10_000, '{"b": 2, "c": 3}', None), (21, None, "package-lock", 1, '{"z": 1}', None), (22, "p", "package-lock", None, '{"z": 1}', None)]
    assert changes(spark, list(reversed(data))) == [("p", 2, "added", "", "b"), ("p", 2, "removed", "a", ""), ("p", 10_000, "added", "", "c")]
    assert changes(spark, data[:0] + rows(None, "", "x")) == []
    assert drift.schema_changes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_file_has_blocks(spark):
    data = [(i, "p", "package-lock", i * 1000, json.dumps({f"f{i}": i}), None) for i in range(1, 40)]
    got = changes(spark, data)
    assert len(got) == 76 and {r[2] for r in got} == {"added", "removed"}


def test_migration(spark):
    fields, steps = drift.migrate_content('{"lockVersion": "2", "package_map": [{"path": "a"}], "odd": 1}', "package-lock")
    assert fields["lockfileVersion"] == 2 and fields["packages"] == {"a": {"path": "a"}} and fields["requires"] is False and fields["odd"] == 1
    assert [s[1] for s in steps] == ["renamed", "renamed", "cast", "cast", "default"]
    fields, steps = drift.migrate_content('{"requirements": {"zlib": "1.2"}, "version": 0.4}', "conan-lock")
    assert fields["requires"] == ["zlib/1.2"] and fields["version"] == "0.4"
    fields, steps = drift.migrate_content('{"graph": "not an object"}', "conan-lock")
    assert "graph_lock#string" in fields and steps[1][1] == "uncast"
    data = rows({"name": "n", "lockfileVersion": 1}, None, "broken", {"lockfileVersion": "x"})
    table = drift.migrate(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.lock_id: r.lockfile_version for r in table} == {0: 1.0, 3: 1.0}
    report = drift.migration_report(spark.createDataFrame(data, SCHEMA)).collect()
    assert ("uncast", "lockfileVersion") in {(r.action, r.field) for r in report}


def test_casts_keep_what_they_cannot_hold(spark):
    needs, refs = {"node": ">=16", "npm": "9"}, [{"ref": "zlib/1.2", "kind": "host"}, "a/1"]
    fields, steps = drift.migrate_content(json.dumps({"requires": needs, "requires#object": 5}), "package-lock")
    assert fields["requires"] is True and fields["requires#object"] == 5 and fields["requires#object#"] == needs
    assert [s[1:] for s in steps[:2]] == [("cast", "requires", "object to boolean"), ("kept", "requires", "requires#object#")]
    fields, steps = drift.migrate_content(json.dumps({"host_requires": refs}), "conan-lock")
    assert fields["requires"] == ["zlib/1.2", "a/1"] and fields["requires#array<object|string>"] == refs
    for value, kind in (({"a": 1}, "object"), ({"a/b": "c"}, "object"), ([1, None], "array<null|number>")):
        assert drift.migrate_content(json.dumps({"requires": value}), "conan-lock")[0][f"requires#{kind}"] == value
    for value in ([{"path": "b"}, {"path": "a"}], [{"path": "x#2"}, {"path": "x"}, {"path": "x"}]):
        fields, _ = drift.migrate_content(json.dumps({"packages": value, "lockfileVersion": "2.0"}), "package-lock")
        assert list(fields["packages"].values()) == value and fields["lockfileVersion#string"] == "2.0" and fields["lockfileVersion"] == 2
    assert drift.migrate_content('{"packages": [{"path": "b"}, {"path": "a"}]}', "package-lock")[0]["packages#array<object>"] == [{"path": "b"}, {"path": "a"}]
    for text, parsed in (('{"requires": {}}', "package-lock"), ('{"requires": {"zlib": "1.2"}}', "conan-lock"), ('{"packages": [{"path": "a"}]}', "package-lock")):
        assert not any(s[1] == "kept" for s in drift.migrate_content(text, parsed)[1])
    one = spark.createDataFrame(rows({"requires": needs}) + rows({"requires": refs}, path="q", parsed="conan-lock"), SCHEMA)
    extra = {r.source_path: r.extra for r in drift.migrate(one).collect()}
    assert json.loads(extra["p"]["requires#object"]) == needs and json.loads(extra["q"]["requires#array<object|string>"]) == refs
    assert {r.field for r in drift.migration_report(one).where("action = 'kept'").collect()} == {"requires"}


def test_deep_contents_are_read(spark):
    from lockgrain.functions.jsontext import _deep_canonical, _deep_kind

    value = {"b": [1.0, {"é": None, "a": [True, [], {}]}, "x\n"], "a": 2.5, "c": [[1], ["x", []]]}
    assert _deep_canonical(value) == canonical(value) and _deep_kind(value["c"]) == kind_of(value["c"]) and _deep_canonical("x") == '"x"'
    deep = '{"dependencies": ' + '{"a": {"dependencies": ' * 900 + "{}" + "}}" * 900 + ', "list": ' + "[" * 1500 + "1" + "]" * 1500 + "}"
    assert len(canonical(read_object(deep))) == len(deep.replace(" ", "")) and kind_of(read_object(deep)["list"]).startswith("array<array<")
    data = rows({"list": 1}, deep, {"list": 1})
    assert changes(spark, data) == [("p", 2, "added", "", "dependencies"), ("p", 2, "retyped", "list", "list"), ("p", 3, "removed", "dependencies", ""), ("p", 3, "retyped", "list", "list")]
    assert {r.lock_id for r in drift.migrate(spark.createDataFrame(data, SCHEMA)).collect()} == {0, 1, 2}
