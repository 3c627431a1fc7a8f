"""Byte-level BPE and token alignment against the public libraries, with brute-force counts of pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import byte_bpe, token_alignment

ODD = [None, "", "a▁b", "<s> hi <|endoftext|> </s>", "  a  b\t\n", "z" * 3000 + "😀" * 200, "é" * 90, " x", "\x00a", "don't 'S 'll '", "日本 語" * 20, "   x \x1c y"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


# 13: byte-level BPE


def test_ranks_are_those_of_the_json(ranks):
    assert byte_bpe.read_json(public_tokenizers.path(token_alignment.FIRST)) == ranks


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abtres'l \n\t1.!é日😀 "), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_ids_are_the_librarys(encoder, library, text):
    ids = encoder.encode(text)
    assert unpacked(ids) == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_a_long_word_is_merged_as_the_library_does(ranks, library):
    rng = random.Random(1)
    for word in ("a" * 5000, "".join(rng.choice("abcdefghij") for _ in range(5000)), "ab" * 2500):
        assert byte_bpe.merged(word.encode(), ranks) == library.encode_ordinary(word)


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 8), (16, 16), (40, 3), (64, 9)])
def test_pieces_of_chunks_give_the_ids_of_the_text(spark, library, chunk, overlap):
    """Chunks of a few characters: words, runs of blanks and contractions lie across their ends, some over whole overlaps."""
    rng = random.Random(3)
    signs = "abc'sre tl  \n\t12é.!?'’ 日本😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += [*ODD, "x" * 300 + " y", "  " * 200, "'s" * 100, "a  \t" * 30, *texts[:5]]
    got = byte_bpe.encode(table(spark, texts), byte_bpe.vocabulary_of(spark), chunk, overlap).collect()
    assert len(got) == len(texts)
    for r in got:
        assert unpacked(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
        assert bytes(r["bytes"]) == (texts[r["doc_id"]] or "").encode()


def test_digests_of_whole_texts(spark, docs, texts, library):
    long = [" ".join(t or "" for t in texts) * 4, "word " * 30_000, "y" * 150_000, "word " * 30_000]
    given_texts = [*texts, *ODD, *long]
    got = {r["doc_id"]: r for r in byte_bpe.op13_byte_bpe(table(spark, given_texts)).collect()}
    assert len(got) == len(given_texts)
    for i, t in enumerate(given_texts):
        ids = library.encode_ordinary(t or "")
        want = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert tuple(got[i]) == want


def test_bpe_of_odd_tables(docs, empty, clashing):
    assert byte_bpe.op13_byte_bpe(empty).count() == 0
    found = byte_bpe.op13_byte_bpe(clashing).collect()
    assert len(found) == docs.count() and sum(r["doc_id"] is None for r in found) == 1
    again = [r for r in found if r["doc_id"] == 0]
    assert len(again) == 2 and again[0] == again[1]
    with pytest.raises(ValueError, match="overlap"):
        byte_bpe.encode(docs, None, 10, 11)


# 11: token alignment


@pytest.fixture(scope="module")
def libraries(ranks):
    first = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_alignment.FIRST))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_alignment.SECOND)), {i: b for b, i in ranks.items()}


def brute_alignment(texts, libraries):
    """Token by token and link by link; (groups, links) of each text and the counts of all pairs."""
    first, second, bytes_a = libraries

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            if any(b"".join(x) != (" " + text).encode() for x in ([bytes_a[i] for i in a], [bytes_b(i) for i in b])):
                a = b = []
        groups, side_a, side_b, end_a, end_b, i, j = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                side_a.append(a[i])
                end_a, i = end_a + len(bytes_a[a[i]]), i + 1
            else:
                side_b.append(b[j])
                end_b, j = end_b + len(bytes_b(b[j])), j + 1
            if end_a == end_b:
                groups.append((side_a, side_b))
                side_a, side_b = [], []
        links = Counter((x, y) for side_a, side_b in groups for x in side_a for y in side_b)
        counts.update(links.keys())
        found.append((len(a), len(b), groups, links))
    return found, counts


def brute_rows(texts, libraries):
    found, counts = brute_alignment(texts, libraries)
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for i, (n_a, n_b, groups, links) in enumerate(found):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        n_best = sum(n for k, n in links.items() if counts[k] == best[k[0]])
        yield i, n_a, n_b, len(groups), sum(links.values()), n_best, sum(n * counts[k] for k, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if n_a else ""


def test_alignment_equals_brute_force(spark, texts, libraries):
    rows = [*texts, *ODD, ("ab " * 40 + "zzzz" * 300) * 3]
    got = token_alignment.op11_token_alignment(table(spark, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == list(brute_rows(rows, libraries))


def test_pair_counts_as_rows_from_several_shards(spark, texts, libraries):
    found = token_alignment.aligned(table(spark, texts), token_alignment.files_of(spark))
    counts = token_alignment.count_pairs(found)
    want = brute_alignment(texts, libraries)[1]
    assert {(r["a_id"], r["b_id"]): r["docs"] for r in counts.table(spark).collect()} == dict(want)
    shards = token_alignment.Shards(counts.shards)
    pairs = np.array(sorted((a << 32) | b for a, b in want), np.int64)
    assert shards.counts(pairs).tolist() == [want[p >> 32, p & 0xFFFFFFFF] for p in pairs.tolist()]


def test_runs_of_pairs_are_summed_across_batches(tmp_path):
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 40, 400) << 32 | rng.integers(0, 3, 400))
    docs = rng.integers(1, 9, 400)
    cuts = [0, 1, 1, 50, 51, 200, 400]
    shard = token_alignment.write_shard(str(tmp_path), ((keys[a:b], docs[a:b]) for a, b in zip(cuts, cuts[1:])))  # noqa: B905
    want = Counter()
    for k, n in zip(keys.tolist(), docs.tolist(), strict=True):
        want[k] += n
    pairs, counts = (token_alignment.mapped(f"{shard['path']}.{x}") for x in ("pairs", "docs"))
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == want and pairs.tolist() == sorted(want)
    assert (shard["low"], shard["high"], shard["pairs"]) == (min(want), max(want), len(want))
    best = dict(zip(token_alignment.numbers(shard["first"]).tolist(), token_alignment.numbers(shard["best"]).tolist(), strict=True))
    assert best == {a: max(n for k, n in want.items() if k >> 32 == a) for a in {k >> 32 for k in want}}
    assert token_alignment.write_shard(str(tmp_path), []) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.lists(st.integers(0, 5), min_size=1, max_size=60)), max_size=8))
def test_links_of_large_and_small_groups(groups):
    """Also groups that are multiplied out by distinct ids."""
    a, b = ([i for g in groups for i in g[side]] for side in (0, 1))
    starts = [np.cumsum([0, *(len(g[side]) for g in groups)]) for side in (0, 1)]
    pairs, times = token_alignment.Groups(np.array(a, np.int64), np.array(b, np.int64), *starts).links()
    want = Counter((x << 32) | y for side_a, side_b in groups for x in side_a for y in side_b)
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == want and sorted(want) == pairs.tolist()


def test_alignment_of_odd_tables(docs, empty, clashing):
    assert token_alignment.op11_token_alignment(empty).count() == 0
    found = token_alignment.op11_token_alignment(clashing).collect()
    assert len(found) == docs.count()
    again = [r for r in found if r["doc_id"] == 0]
    assert len(again) == 2 and again[0] == again[1]
    nothing = [tuple(r)[1:] for r in found if r["n_a"] == 0]
    assert nothing and set(nothing) == {(0, 0, 0, 0, 0, 0, "")}
