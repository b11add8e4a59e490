import pytest

WORDS = ("river stone walks under quiet morning light while seven boats drift past the old harbour "
         "and nobody counts them twice because every captain knows his own lantern by heart").split()


def prose(k: int, n: int) -> str:
    """n words that differ between k's."""
    return " ".join(f"{WORDS[(i * (k + 3) + i // 7) % len(WORDS)]}{(i * k) % 11 or ''}" for i in range(n))


LONG = prose(5, 9000)
SHARED = prose(6, 60)
EDGE = [
    (0, prose(1, 120), "en", "a"),
    (1, prose(1, 120), "en", "a"),                          # exact copy
    (1, prose(1, 120), "en", "a"),                          # repeated row
    (2, prose(1, 119) + " changed", "en", "b"),             # near copy
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \t\n\r\x0b\f ", "fr", None),
    (6, "one", "fr", "c"),
    (7, "one", "fr", "c"),
    (8, "ONE", "de", "c"),
    (9, LONG, "en", "a"),
    (10, "x" * 40_000, "en", "b"),                          # one very long word
    (11, "la " * 4000, "fr", "d"),                          # one word over and over
    (12, "12 34 567 !!", "en", "a"),                        # no letter
    (13, prose(2, 80) + " " + SHARED + " " + prose(3, 80), "en", "a"),
    (14, prose(4, 80) + " " + SHARED + " é ß ž", "fr", "z"),
    (None, prose(7, 60), None, "a"),
    (None, None, "en", "b"),
    (20, prose(8, 50) + "\n" + prose(8, 50) + "\n" + prose(8, 50), "en", "a"),
    (40, "mail me at some.one@mail.example.com or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111", "en", "b"),
]
CLASHING = ["shard", "slot", "size", "score", "kept", "n_words", "begin", "seed", "key", "root", "term", "slice",
            "rank", "item", "word", "near", "form", "host", "path", "rule", "verdict", "_canonical",
            "_words", "_sorted", "_placed", "_lines", "_n_lines", "_failed", "_row_key", "_spans", "_lang", "_id", "_no_id",
            "_text_key", "_row", "_again"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          + ", ".join(f"{c} string" for c in CLASHING) + ", nested map<string, int>")


def rows(edge):
    return [(i, t, lang, src, len(t or ""), *["mine"] * len(CLASHING), {"a": 1}) for i, t, lang, src in edge]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(EDGE), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    from tests.conftest import SF_SMALL
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")
