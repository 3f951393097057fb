"""Long texts full of candidates, sentinels that could clash, repeated ids, and folders on a cluster."""

import time

import pytest
from lodestone.llm import chat, common, quality, secrets

from tests.llm.test_chat import plain, whole


def test_many_hex_tokens_take_linear_time():
    text = " ".join(f"{k:032x} Zk9Qw3Rt7Yx1Lm5Np8Vb2Hc{k}" for k in range(16_000))
    began = time.time()
    base = secrets.base_spans(text)
    added = secrets.entropy_spans(text, base)
    assert len(base) == len(added) == 16_000 and time.time() - began < 20


def test_a_long_taken_span_bars_all_candidates_in_it():
    taken = [(0, "assign", 100), (10, "hex", 40)]
    assert secrets.entropy_spans(" " * 50 + "Zk9Qw3Rt7Yx1Lm5Np8Vb2Hc" + " " * 50, taken) == []
    assert len(secrets.entropy_spans(" " * 100 + "Zk9Qw3Rt7Yx1Lm5Np8Vb2Hc", taken)) == 1


@pytest.mark.parametrize("word", ["q7w2z9x4k1m8v3b6n5j0", "Q7W2Z9X4K1M8V3B6N5J0", "QzWxEcRvTbYnUmIkOlPaSd"])
def test_every_class_has_its_own_threshold(word):
    names = [n for n, runs, least in secrets.CLASSES for run in runs.finditer(word) if secrets.peak_entropy(run.group()) >= least]
    assert names


def test_numbers_that_stand_for_null_elsewhere(spark):
    rows = [(-1, -1, "anna", "minus"), (None, None, "anna", "none"), (-1, None, "ben", "first"), (None, -1, "ben", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate(df).collect()
    assert {(r.conv_id, r.turn) for r in got} == {(r[0], r[1]) for r in rows}
    assert [(r.turn, r.segment.split("\n")[1]) for r in sorted(got, key=lambda r: r.position) if r.conv_id == -1 and r.perspective == "anna"] == [(None, "first<|end|>"), (-1, "minus<|end|>")]


def test_people_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(chat, "BROADCAST_PEOPLE", 0)
    rows = [(1, k % 50, f"p{k % 3}", f"t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert whole(chat.rotate(df)) == plain(rows)


def test_character_trigrams_are_of_code_points():
    hashes = quality.WordHashes().of([])
    assert len(quality.buckets("é\U0001f600ab".encode(), hashes)[2]) == 2


def test_a_repeated_id_sends_one_text(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert common.labelled_sample(docs, labels, "toxic", 10, 100) == [(b"a", 1), (b"c", 0)]


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        master, conf = "spark://host:7077", Conf()

        def getConf(self):
            return Conf()

    fake = Fake()
    fake.sparkContext = fake
    with pytest.raises(RuntimeError):
        common.shared_dir(fake)
