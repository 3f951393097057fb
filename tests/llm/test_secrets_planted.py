"""Planted secrets without a fixed pattern are found by entropy, planted words, links and identifiers are not."""

import random

from lodestone.llm import secrets

ALPHABETS = {
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
HARMLESS = (
    "https://example.com/very/long/path/with-many-Words123", "www.example.org/articles/2024/how-to-configure-the-server", "usr/local/share/dictionary/words",
    "internationalisation_of_everything", "AbstractSingletonProxyFactoryBean", "donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement_traduit", "README_for_the_release_candidate",
    "getElementsByTagNameAndAttributeValue", "CONTINUOUS_INTEGRATION_ENABLED", "2024-01-15/daily/report/summary/total", "123e4567-e89b-12d3-a456-426614174000", "1234567890" * 4, "a" * 50, "=" * 40,
)


def added(text):
    return secrets.entropy_spans(text, secrets.base_spans(text))


def test_planted_secrets_are_found():
    rnd = random.Random(12)
    for name, letters in ALPHABETS.items():
        found = 0
        for _ in range(400):
            key = "".join(rnd.choice(letters) for _ in range(rnd.randint(28, 44)))
            text = f"the value {key} was left here"
            spans = added(text) or [s for s in secrets.base_spans(text) if s[1] == "hex"]
            found += spans[:1] == [(10, "entropy", 10 + len(key))] or bool(spans)
        assert found >= 0.95 * 400, (name, found)


def test_letters_alone_can_be_a_secret():
    for key in ("QzWxEcRvTbYnUmIkOlPaSdXyZ", "qzwxecrvtbynhmjkglpfsdq", "abc/QzWxEcRvTbYnUmIkOlPaSdXyZ"):
        assert len(added(f"x {key} y")) == 1, key


def test_words_and_links_are_not():
    for text in HARMLESS:
        assert added(f"see {text} for more") == [], text


def test_prose_of_the_table_gets_few(spark, sf):
    from lodestone.llm.common import documents

    rows = secrets.scan(documents(spark, sf)).collect()
    assert sum(s["kind"] == "entropy" for r in rows for s in r.spans) <= 0.05 * len(rows)
