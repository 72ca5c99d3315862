"""One passage in thousands of differing contexts."""

import random

from folio.llm import substrings
from tests.llm.helpers import SCHEMA
from tests.llm.test_text_operators import documents, plain_substrings


def test_groups_stay_bounded_where_contexts_differ(spark, monkeypatch):
    rng = random.Random(7)
    shared = " ".join(f"shared{i}" for i in range(30))
    word = lambda: f"w{rng.randrange(10**6)}"
    contexts = [" ".join(word() for _ in range(rng.randint(3, 25))) + f" {shared} " + " ".join(word() for _ in range(rng.randint(3, 25))) for _ in range(3000)]
    # Some contexts come again, so that windows over the passage's edge are repeated too.
    texts = contexts + [f"other {word()} {c} {word()}" for c in contexts[::50]] + [f"{shared} " * 3]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(substrings, "SHARD", 100)
    search = substrings.search

    def bounded(shard):
        assert len(shard.drop_duplicates(["h", "c"])) <= 1000
        return search(shard)

    monkeypatch.setattr(substrings, "search", bounded)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_report(df).collect()}
    assert got == {doc_id: x for (doc_id, _), x in plain_substrings(documents(df)).items()}
