"""The chain is fitted on whole sentences, and on sentences of all documents."""

from lodestone.llm import toxicity


def weight(sample):
    return toxicity.fit_chain(sample, [b"first", b"later"]).here[2]


def test_words_past_the_first_tokens_train():
    long = b"plain " * 200
    sample = [(long + b"later " + long, 1)] * 20 + [(b"first word here", 1)] * 20 + [(long, 0)] * 20
    assert weight(sample) > 0.1


def test_sentences_are_not_taken_by_document_order():
    early = [(b"first %d" % k, 1) for k in range(toxicity.SENTENCES // 2)]
    late = [(b"later %d" % k, 1) for k in range(toxicity.SENTENCES // 2)]
    assert weight(early + late) > 0.1
