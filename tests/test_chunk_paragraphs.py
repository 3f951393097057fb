"""A paragraph loses the spaces around it and nothing else."""

from lodestone.operators import chunking


def test_digits_stay(spark):
    row = spark.createDataFrame([(1, "0 zero 00\n 11 one 1 \n\n  \n2 two 2")], "doc_id long, text string")
    got = [(r.position, r.paragraph) for r in chunking.paragraphs(row, "doc_id", "text", "\n").orderBy("position").collect()]
    assert got == [(0, "0 zero 00"), (1, "11 one 1"), (2, "2 two 2")]
