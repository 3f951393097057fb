"""Python holds the results of a few rows at once, not of a whole batch."""

import pandas as pd
from lodestone.functions import batches
from lodestone.operators import headings


def test_slices_keep_every_row():
    some = [(pd.Series(range(300)), pd.Series(range(300))), (pd.Series([]), pd.Series([])), (pd.Series([7]), pd.Series([8]))]
    got = list(batches.slices(iter(some)))
    assert max(len(a) for a, _ in got) == batches.SLICE and [x for a, _ in got for x in a] == [*range(300), 7] and [x for _, b in got for x in b] == [*range(300), 8]
    assert [len(s) for (s,) in batches.slices(iter([pd.Series(range(130))]))] == [128, 2]


def test_sections_of_many_rows_of_one_task(spark):
    df = spark.range(1000).repartition(1).selectExpr("id", "IF(id % 7 = 0, NULL, concat('# A', id, '\n\ntext\n\n# B\n\nmore\n\n# C\n\nend')) AS md")
    out = headings.sections(df, "id", "md")
    assert "ArrowEvalPython" in out._jdf.queryExecution().toString() and ", 204" in out._jdf.queryExecution().toString()
    got = out.groupBy("id").count().collect()
    assert len(got) == 857 and {r["count"] for r in got} == {3}
