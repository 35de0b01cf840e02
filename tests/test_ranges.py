import random

from pyspark.sql import functions as F

from quarry.operators import ranges


def test_blocks_cover_each_range_once(spark):
    random.seed(4)
    rows = [(k, *sorted(random.choices(range(300), k=2))) for k in range(200)] + [(900, 0, 0), (901, 0, 2**31 - 2), (902, 7, 7), (903, 5, 4)]
    got = {}
    for r in ranges.covered(spark.createDataFrame(rows, "k int, a int, b int"), "a", "b").collect():
        got.setdefault(r["k"], []).append((r["bin"] << r["level"], (r["bin"] + 1 << r["level"]) - 1, r["level"]))
    for k, a, b in rows:
        blocks = sorted(got.get(k, []))
        assert all(x[1] + 1 == y[0] for x, y in zip(blocks, blocks[1:])) and max([0, *[[z[2] for z in blocks].count(x[2]) for x in blocks]]) <= 2
        assert (blocks[0][0], blocks[-1][1]) == (a, b) if a <= b else not blocks


def test_points_in_ranges(spark):
    random.seed(5)
    held = [(k, f"f{random.randint(0, 2)}", a := random.randint(0, 500), a + random.choice([-1, 0, 3, 40, 400])) for k in range(300)]
    points = [(f"f{random.randint(0, 3)}", random.randint(0, 999)) for _ in range(300)]
    df = spark.createDataFrame(held, "id int, file string, a int, b int")
    got = ranges.containing(spark.createDataFrame(points, "file string, line int").distinct(), df, "file", "line", "a", "b")
    want = sorted((f, x, k) for f, x in set(points) for k, g, a, b in held if f == g and a <= x <= b)
    assert sorted(map(tuple, got.select("file", "line", "id").collect())) == want
    assert ranges.containing(spark.createDataFrame(points, "file string, line int"), df.filter(F.lit(False)), "file", "line", "a", "b").count() == 0
