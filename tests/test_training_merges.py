"""Merge training with an index against counting everything anew for each merge."""

import random
from collections import Counter

import pytest

from quarry.operators import tokens


def brute(pieces, n_merges):
    words = {tuple(p.encode("latin-1")): n for p, n in pieces}
    out = []
    while len(out) < n_merges:
        counts = Counter()
        for w, n in words.items():
            for pair in zip(w, w[1:]):
                counts[pair] += n
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        out.append((*best, counts[best]))
        merged = Counter()
        for w, n in words.items():
            s, i = [], 0
            while i < len(w):
                hit = w[i : i + 2] == best
                s.append(255 + len(out) if hit else w[i])
                i += 1 + hit
            merged[tuple(s)] += n
        words = merged
    return out


def corpus(seed, letters, n, longest):
    r = random.Random(seed)
    return [(p, r.randint(1, 9)) for p in sorted({"".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(n)})]


@pytest.mark.parametrize("pieces", [corpus(1, "abc", 60, 9), corpus(2, "abcdefgh \xe9\xc3", 200, 7), corpus(3, "ab", 9, 14), [("a", 4)], [("aaaaaaa", 2), ("aaaa", 1)]], ids=["few", "many", "two", "none", "runs"])
def test_merges_equal_counting_anew(spark, pieces):
    df = spark.createDataFrame(pieces, "piece string, n long")
    assert tokens.train(df, 30) == brute(pieces, 30)


def test_counts_that_are_not_held_are_counted_again(spark):
    pieces = corpus(4, "abcdef", 150, 6)
    assert tokens.train(spark.createDataFrame(pieces, "piece string, n long"), 20, held=5) == brute(pieces, 20)


def test_200_merges_take_fewer_jobs_than_merges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = [(r.piece, r.n) for r in tokens.piece_counts(docs).collect()]
    df = spark.createDataFrame(pieces, "piece string, n long")
    spark.sparkContext.setJobGroup("merges", "")
    found = tokens.train(df, 200)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("merges")
    spark.sparkContext.setJobGroup("", "")
    assert found == brute(pieces, 200)
    assert len(jobs) < 200


def test_no_choice_depends_on_another():
    counts = {(1, 2): 9, (3, 4): 8, (2, 5): 7, (6, 7): 7, (8, 9): 6}
    assert tokens.independent(counts, 0, 8) == [((1, 2), 9), ((3, 4), 8)]  # (6, 7) ties with a pair that shares a symbol
    assert tokens.independent({(1, 1): 5, (1, 2): 4}, 0, 8) == [((1, 1), 5)]
    assert tokens.independent({(1, 2): 5, (3, 4): 4}, 4, 8) == [((1, 2), 5)] and tokens.independent({(1, 2): 5}, 5, 8) == []


def test_a_piece_of_a_million_letters_encodes_quickly():
    coder = tokens.RankedMerges([(97, 97), (256, 256), (257, 98)])
    assert len(coder.encode("a" * 1_000_001)) == 250_001
    r, merges = random.Random(5), [(97, 98), (98, 97), (256, 256), (97, 97), (258, 257)]
    plain = tokens.RankedMerges(merges)
    for _ in range(300):
        s = [97 + r.randrange(2) for _ in range(r.randint(0, 12))]
        w = list(s)
        while ranked := [(merges.index(p), i) for i, p in enumerate(zip(w, w[1:])) if p in merges]:
            k, i = min(ranked)
            w[i : i + 2] = [256 + k]
        assert plain.symbols(bytes(s)) == w
