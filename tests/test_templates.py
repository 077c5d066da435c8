"""Templates: level numbers against plain Python, empty tables."""

import random

from docloom.operators import templates



def test_level_numbers_equal_a_plain_count(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice([None, 0, 1, 2, 3, 3, 4, 11])) for d in range(20) for i in range(30)]
    want, counts = {}, {}
    for d, i, level in rows:
        if i == 0:
            counts = {}
        if level is not None and 1 <= level <= 10:
            counts = {k: n for k, n in counts.items() if k <= level}
            counts[level] = counts.get(level, 0) + 1
        want[d, i] = counts[level] if level is not None and 1 <= level <= 10 else None
    out = templates.level_numbers(spark.createDataFrame(rows, "d int, i int, level int"), "d", ["i"], "level")
    assert {(r.d, r.i): r.number for r in out.collect()} == want


def test_empty_tables(spark):
    places = spark.createDataFrame([], "doc string, pos int, name string, guide string, field_type string, value string, filled boolean")
    assert templates.merge_fields(places, "doc").count() == 0
    assert templates.group_counts(places, "doc", r"^a(\d+)$", r"^b(\d+)-(\d+)$", 5, 5).count() == 0
    assert templates.level_numbers(places, "doc", ["pos"], "pos").count() == 0
