import duckdb
from lodestone.llm import chat
from lodestone.llm.common import table


def plain(rows):
    """Renderings by the plainest means: {(conv, perspective): (text, loss spans)}."""
    import hashlib

    rows = [(c if c is not None else -1, t if t is not None else -1, r or "unknown", x or "") for c, t, r, x in rows]
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((t, hashlib.md5(f"{r}\x1f{x}".encode()).hexdigest(), r, x) for cc, t, r, x in rows if cc == c)
        for who in {r for _, _, r, _ in mine} - {"system"}:
            text, spans = "", []
            for _, _, r, x in mine:
                text += "<|system|>\n" if r == "system" else "<|assistant|>\n" if r == who else f"<|user {r}|>\n"
                if r == who:
                    spans.append((len(text), len(text) + len(x) + 8))
                text += x + "<|end|>\n"
            out[(c, who)] = (text, spans)
    return out


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.position):
        k = (r.conv_id if r.conv_id is not None else -1, r.perspective)
        text, spans = out.get(k, ("", []))
        assert r.start == len(text) and r.end - r.start == len(r.segment)
        if r.loss:
            spans = [*spans, (r.loss_start, r.loss_end)]
        out[k] = (text + r.segment, spans)
    return out


def test_odd_rows(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "anna", "hi é\U0001f600"), (1, 2, "ben", None), (1, 2, "ben", "yo"), (1, 2, "ben", "yo"), (1, None, None, ""), (2, 0, "system", "alone"), (None, 5, "anna", "lost"), (1, 9000, "cleo", "late"), (1, 70, "anna", "mid")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")
    assert whole(chat.rotate(df)) == plain(rows)
    assert chat.rotate(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    df = table(spark, sf, "conversations")
    assert whole(chat.rotate(df)) == plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_one_long_conversation(spark):
    rows = [(1, k % 700, f"p{k % 3}", f"t{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert whole(chat.rotate(df)) == plain(rows)


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(chat.ORACLE).fetchall()
    got = chat.rotate(table(spark, sf, "conversations")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
