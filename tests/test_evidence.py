import pytest
from pyspark.sql import functions as F

from framewright.operators import evidence as V


def test_aliases_follow_the_last_declaration_before(spark):
    rows = [
        ("m", 1, "a", None, None, "f1"), ("m", 2, "b", "a", 1, None), ("m", 3, "a", None, 0, "f3"), ("m", 4, "c", "b", 1, None), ("m", 5, "d", "a", 1, None),
        ("m", 6, "a", "a", 1, None), ("m", 7, "e", "zz", 0, None), ("m", 8, "g", "e", 0, None), ("n", 1, "q", "a", 0, None), ("m", 9, "h", "a", 0, None),
    ]
    df = spark.createDataFrame(rows, "m string, o int, name string, target string, flips int, frames string")
    got = {(r["m"], r["o"]): (r["shown"], r["mirrored"], r["fault"]) for r in V.aliased_actions(df, "m", "o", "name", "target", "flips", "frames").collect()}
    assert got == {
        ("m", 1): ("f1", False, ""), ("m", 2): ("f1", True, ""), ("m", 3): ("f3", False, ""), ("m", 4): ("f1", False, ""), ("m", 5): ("f3", True, ""),
        ("m", 6): ("f3", True, ""), ("m", 7): (None, False, "target_not_declared"), ("m", 8): (None, False, "target_quarantined"),
        ("n", 1): (None, False, "target_not_declared"), ("m", 9): ("f3", True, "")}
    assert V.aliased_actions(df.limit(0), "m", "o", "name", "target", "flips", "frames").count() == 0


@pytest.mark.parametrize("value, path", [
    ({"a": {"Crop": None, "uv_rect_2": 1}}, "$.a.uv_rect_2"), ({"b": [{"X": 1, "y": 2, "W": 3, "h": 4}]}, "$.b[0]"), ({"is_in_rect": 1, "own_bbox": 0}, "$.own_bbox"),
    ({"left": 1, "top": 2, "right": 3}, None), ([], None), (None, None), ({"z": 1, "cell": 2}, "$.cell"),
])
def test_places_in_documents(value, path):
    assert V.place_in(value) == path


def test_documents_that_are_no_json(spark):
    df = spark.createDataFrame([("{broken",), (None,), ("",), ('{"bbox":1}',)], "t string")
    assert [r[0] for r in df.select(V.sheet_place(F.col("t"))).collect()] == [None, None, None, "$.bbox"]


def test_versions_appear_whole(spark, tmp_path):
    root = str(tmp_path / "index")
    one, two = spark.range(3), spark.range(5)
    V.write_together({"a": one, "b": two}, root, "v1")
    assert V.read_current(spark, root, "b").count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        V.write_together({"a": two}, root, "v1")
    assert V.read_current(spark, root, "a").count() == 3
    V.write_together({"a": two}, root, "v2")
    assert V.read_current(spark, root, "a").count() == 5
    with pytest.raises(KeyError):
        V.read_current(spark, root, "b")


def test_shapes(spark):
    df = spark.createDataFrame([("a", "8x8"), ("a", "8x8"), ("b", "8x8"), ("b", None), ("c", None)], "g string, s string")
    assert {r["g"]: r["can_stack"] for r in V.shape_checks(df, "g", F.col("s")).collect()} == {"a": True, "b": False, "c": False}
