from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import mixing
from lexiloom.llm.secret_scan import VOCABULARY, encoding

END = 50256


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab 'sé,.×1\n 　日—Z", max_size=30)), min_size=1, max_size=6))
def test_pieces_encode_as_whole_texts(rows):
    tokens, first = mixing.tokenise(pa.array(rows, pa.string()), VOCABULARY, END)
    encode = encoding(VOCABULARY).encode_ordinary
    for i, r in enumerate(rows):
        assert tokens[first[i] : first[i + 1]].tolist() == ([*encode(r), END] if r else [])


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(p.tolist()) == list(range(n))
    a, b = (mixing.permuted(np.arange(100), np.full(100, 100), np.full(100, k, np.uint64)).tolist() for k in (1, 2))
    assert a != b


def corpus() -> list[tuple]:
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 7)))
    return [(i, " ".join(word() for _ in range(rng.randrange(1, 120))), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(150)]


def test_blocks_hold_each_token_once_and_counts_are_the_draws(docs_of):
    rows = corpus()
    out = mixing.mix_sources(docs_of(rows).repartition(5), length=64, shard_size=16, slots=200, weights={"a": 1.0, "b": 2.0, None: 1.0, "none": 5.0}, seed=3).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(s, i) for s in range(13) for i in range(16 if s < 12 else 8)]
    encode = encoding(VOCABULARY).encode_ordinary
    streams = defaultdict(Counter)
    sizes = Counter()
    for _, t, _, s in rows:
        x = [*encode(t), END]
        streams[s].update(x)
        sizes[s] += len(x)
    seen = defaultdict(dict)
    for r in out:
        assert len(r.tokens) == 64
        assert seen[r.source].setdefault(r.block, r.tokens) == r.tokens
    names = sorted(["a", "b", mixing.NO_SOURCE])
    share = np.array([{"a": 1, "b": 2, mixing.NO_SOURCE: 1}[n] for n in names]) / 4
    for shard in range(13):
        want = mixing.shard_counts(3, shard, 16 if shard < 12 else 8, share)
        have = Counter(r.source or mixing.NO_SOURCE for r in out if r.shard == shard)
        assert [have[n] for n in names] == want.tolist()
    for s, blocks in seen.items():
        n = -(-sizes[s] // 64)
        draws = Counter(r.block for r in out if r.source == s)
        if sum(draws.values()) >= n:  # a whole pass: every block, evenly, with all tokens of the source
            assert set(blocks) == set(range(n)) and max(draws.values()) - min(draws.values()) <= 1
            whole = Counter(t for b in blocks.values() for t in b)
            whole[END] -= n * 64 - sizes[s]
            assert +whole == streams[s]
    by_doc = {d: s for d, _, _, s in rows}
    assert all(by_doc[d] == r.source for r in out for d in r.doc_ids if d is not None)


def test_documents_follow_one_another_within_blocks(docs_of):
    rows = [(i, "word " * (i + 1), "en", "a") for i in range(10)]
    out = sorted(mixing.mix_sources(docs_of(rows).coalesce(1), length=16).collect(), key=lambda r: r.block)
    encode = encoding(VOCABULARY).encode_ordinary
    stream = [t for _, x, *_ in rows for t in [*encode(x), END]]
    stream += [END] * (-len(stream) % 16)
    assert [t for r in out for t in r.tokens] == stream


def test_odd_rows(docs_of):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "long text " * 100_000, "en", "b"), (None, "no id", "en", None), (4, "twice", "en", "a"), (4, "twice", "en", "a")]
    out = mixing.mix_sources(docs_of(rows, extra=True), length=128).collect()
    assert {r.source for r in out} <= {"a", "b", None} and all(len(r.tokens) == 128 for r in out)
    assert mixing.mix_sources(docs_of([])).count() == 0 and mixing.mix_sources(docs_of(rows[:2])).count() == 0
    assert mixing.mix_sources(docs_of(rows), weights={"missing": 1.0}).count() == 0


def test_sums_before_are_those_of_one_pass(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randrange(5)) for g in ("a", "b", None) for i in range(100) if rng.random() < 0.8]
    got = {(r.g, r.i): r.before for r in mixing.sums_before(spark.createDataFrame([r for r in rows if r[0]], "g string, i long, n long"), "g", "i", "before", run=7).collect()}
    for g in "ab":
        total = 0
        for _, i, n in [r for r in rows if r[0] == g]:
            assert got[g, i] == total
            total += n


def test_vocabularies_of_any_size(docs_of, tmp_path):
    import base64

    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % (70_000 + i) for i in range(256)))
    out = mixing.mix_sources(docs_of([(1, "abc"), (2, "de")]).coalesce(1), length=4, vocabulary=str(path), end=80_000).collect()
    tokens = [t for r in sorted(out, key=lambda r: r.block) for t in r.tokens]
    assert tokens == [70_097, 70_098, 70_099, 80_000, 70_100, 70_101, 80_000, 80_000]
