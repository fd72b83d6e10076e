"""Packing, segmentation, chat formatting and fingerprints."""

import random
import re
import time
from binascii import crc32
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressmill.llm import chat, fingerprints, packing, pieces
from pressmill.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def word():
    from tokenizers import Tokenizer

    return packing.ChunkEncoder(tokenizer_file(WORD), most_chars=60), Tokenizer.from_file(tokenizer_file(WORD))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aBcétñİßſΣ' .,!?|<>#5\n\t ́日", "<|endoftext|>", "it's", "don't "]), max_size=30))
def test_chunks_give_the_ids_of_the_whole(word, parts):
    (encoder, whole), text = word, "".join(parts)
    assert encoder.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def checked_packing(rows, lengths, capacity):
    """Pieces cover documents, sequences are gapless and within capacity; the number of sequences."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(r.length for r in rows) == sorted(lengths)
    return len(sequences)


def test_packing(spark, word):
    rows = [(1, None), (2, ""), (3, "word " * 30), (4, "some words and more"), (4, "some words and more"), (None, "x")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, place string, shard int")
    got = packing.pack(docs, tokenizer_file(WORD), capacity=12).collect()
    lengths = []
    for _, text in rows:
        n = len(word[1].encode(text or "", add_special_tokens=False).ids) + 1
        lengths += [12] * (n // 12) + [n % 12] * (n % 12 > 0)
    assert checked_packing(got, lengths, 12) == -(-sum(lengths) // 12)
    third = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 3)
    ids = word[1].encode("word " * 30, add_special_tokens=False).ids + [0]
    assert third == [(k, 12 * k, len(p), crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[a : a + 12] for a in range(0, len(ids), 12))]
    assert packing.pack(docs.limit(0), tokenizer_file(WORD)).count() == 0


def test_shards_and_whole_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, tokenizer_file(WORD), shard_pieces=60).collect()
    whole = QUERIES["op10_best_fit_packing"](spark, SF).collect()
    lengths = [r.length for r in whole]
    assert sorted(lengths) == sorted(r.length for r in rows)
    assert checked_packing(whole, lengths, 2048) <= -(-sum(lengths) // 2048) + 1
    assert checked_packing(rows, lengths, 2048) <= -(-sum(lengths) // 2048) + 8


def test_local_search_beats_best_fit():
    """Six thirds and halves that best fit places badly; and never more sequences than best fit."""
    assert len(packing.pack_lengths([6, 5, 5, 4, 4, 3, 3], 10)) == 3
    r = random.Random(5)
    for _ in range(60):
        lengths = [r.randint(1, 70) for _ in range(r.randint(1, 60))]
        start = packing.best_fit(lengths, 100)
        search = packing.Exchange(lengths, [list(b) for b in start], 100)
        squares = sum(f * f for f in search.fill)
        found = search.search()
        assert sorted(i for b in found for i in b) == list(range(len(lengths)))
        fills = [sum(lengths[i] for i in b) for b in found]
        assert max(fills) <= 100 and len(found) <= len(start) and sum(f * f for f in fills) >= squares


def test_pairs_of_sequences_of_many_documents():
    """Only a pair of the 24 documents makes room for the eleven; many documents of few lengths cost little."""
    lengths = [4] * 24 + [11]
    found = packing.Exchange(lengths, [list(range(24)), [24]], 100).search()
    assert sorted(sum(lengths[i] for i in b) for b in found) == [8, 99]
    lengths = [random.Random(k).randint(90, 130) for k in range(8_000)]
    bins = packing.pack_lengths(lengths, 2048)
    assert len(bins) <= -(-sum(lengths) // 2048) + 5
    ones = packing.Exchange([1] * 2000, [list(range(1990)), list(range(1990, 2000))], 2048)
    assert [len(g) for g in ones.groups(0)] == [0, 1, 2]


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(tokenizer_file(PIECE))


def every_way(lattice, text):
    whole, out = pieces.BLANK + text.replace(" ", pieces.BLANK) if text else "", []

    def go(i, score, ids):
        if i == len(whole):
            out.append((score, ids))
        else:
            for j, s, more in lattice.edges(whole, i):
                go(j, score + s, ids + more)

    go(0, 0.0, b"")
    return sorted(out, key=lambda x: -x[0])


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="the an\né日", max_size=8), st.integers(1, 7))
def test_n_best_equals_all_ways(lattice, text, n):
    ways, got = every_way(lattice, text), lattice.segment(text, n)
    assert [s for s, _ in got] == [s for s, _ in ways[:n]] and set(got) <= set(ways) and len({i for _, i in got}) == len(got)
    assert lattice.decode(got[0][1]) == text


@pytest.mark.parametrize("text", ["aaaaaaaa", "--------", "abababab", "a-a-a-a-"])
def test_n_best_of_repeated_letters(lattice, text):
    for n in (1, 2, 5, 30):
        ways, got = every_way(lattice, text), lattice.segment(text, n)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in ways[:n]], abs=1e-9) and len({i for _, i in got}) == len(got) == min(n, len(ways))
        assert {i for _, i in got} <= {i for _, i in ways}


@pytest.mark.parametrize("text", ["a", "-", "=", "ab"])
def test_long_runs_of_a_character_cost_in_proportion(lattice, text):
    start = time.time()
    found = lattice.segment(text * (200_000 // len(text)), 5)
    assert len(found) == 5 and [f[0] for f in found] == sorted((f[0] for f in found), reverse=True)
    assert all(lattice.decode(ids) == text * (200_000 // len(text)) for _, ids in found)
    assert time.time() - start < 60


def test_segmentation_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a▁b", 0.5), (4, "the cat", 0.5), (4, "the cat", 0.5)], "doc_id long, text string, score double")
    got = sorted(pieces.segmented(docs, tokenizer_file(PIECE)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_pieces, r.round_trip) for r in got[:3]] == [(0, True), (0, True), (2, False)]  # ▁a ▁b, as for a blank
    assert got[3] == got[4] and [b.score for b in got[3].best] == sorted((b.score for b in got[3].best), reverse=True)
    assert pieces.segmented(docs.limit(0), tokenizer_file(PIECE)).count() == 0
    whole = QUERIES["op7_sentencepiece_nbest"](spark, SF).collect()
    assert len(whole) == 200 and all(r.round_trip for r in whole)


@given(st.text(alphabet="<\\|im_startend>ax", max_size=20))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_conversations_read_back(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = {
        7: [("user", "Hi there"), ("assistant", "  Hello\n\nyou é日😀 "), ("assistant", ""), ("user", said), ("assistant", said)],
        8: [("system", ""), ("", "no role"), ("assistant", "<\\|im_sep|> <| end")],
        9: [("user", "x")] * 3,
    }
    rows = [(c, t, role or None, text or None, "x") for c, all_turns in turns.items() for t, (role, text) in enumerate(all_turns)]
    rows += [(None, 1, "assistant", "lost", "y"), (None, None, "user", "first", "y")]
    turns[None] = [("user", "first"), ("assistant", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(5)
    path = tokenizer_file(BYTE)
    for part_chars in (1 << 20, 10):
        got = {r.conv_id: r for r in chat.read_back(chat.formatted(df, path, part_chars), path).collect()}
        assert set(got) == set(turns)
        for conv, wanted in turns.items():
            r, learnt = got[conv], "".join(t for role, t in wanted if role == "assistant")
            assert (r.n_turns, r.turns_sha256) == (len(wanted), sha256("".join(f"{a}\n{b}\n" for a, b in wanted).encode()).hexdigest())
            assert (r.loss_chars, r.loss_sha256) == (len(learnt), sha256(learnt.encode()).hexdigest())
            assert r.formatted_chars == len(chat.rendered(wanted)[0])
    assert chat.read_back(chat.formatted(df.limit(0), path), path).count() == 0


def test_chat_query(spark):
    got = {r.conv_id: r for r in QUERIES["op5_chat_formatting"](spark, SF).collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 34
    by = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    for conv, rows in by.items():
        text = "".join(f"{role}\n{t}\n" for _, role, t in sorted(rows))
        assert got[conv].turns_sha256 == sha256(text.encode()).hexdigest()


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_edit_distance(a, b):
    assert fingerprints.edits(a, b) == plain_edits(a, b)


def plain_fingerprint(text):
    data, powers = text.encode(), fingerprints.Powers()
    hashes = []
    for end in range(len(data)):
        w = [data[end - k] if end >= k else 0 for k in range(7)]
        shifted = 0
        for k in range(7):
            shifted ^= (w[k] << (5 * k)) & 0xFFFFFFFF
        hashes.append((sum(w) + sum(w[k] * (7 - k) for k in range(7)) + shifted) & 0xFFFFFFFF)

    def marks(size):
        out, chunk = "", []
        odd = int(fingerprints.ODD)
        for byte, h in zip(data, hashes):
            chunk.append(byte)
            if h % size == size - 1:
                out, chunk = out + one(chunk, odd), []
        return out + one(chunk, odd) if chunk else out

    def one(chunk, odd):
        total = sum((b + 1) * pow(odd, k, 1 << 64) for k, b in enumerate(chunk)) % (1 << 64)
        return chr(fingerprints.LETTERS[((total * odd) % (1 << 64)) >> 58])

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and sum(h % size == size - 1 for h in hashes) + 1 < 32:
        size //= 2
    assert fingerprints.fingerprint(text, powers) == f"{size}:{marks(size)}:{marks(2 * size)}"


def test_fingerprint_equals_the_plain_one():
    r = random.Random(2)
    for n in (0, 1, 2, 9, 200, 900, 3000):
        plain_fingerprint("".join(r.choice("abcdé \n") for _ in range(n)))
    plain_fingerprint("a" * 700)


def test_compared_with_the_next_document(spark):
    r = random.Random(4)
    rows = [(k * 3 % 41, "".join(r.choice("abcde fgh") for _ in range(r.randint(0, 90)))) for k in range(41)]
    rows += [(7, None), (None, "no id"), (20, rows[0][1])]
    docs = spark.createDataFrame([(*x, "t", 1) for x in rows], "doc_id long, text string, tie string, tail int")
    plain = [(d, t or "") for d, t in rows]
    for range_rows in (3, 5000):
        got = fingerprints.compared(docs, range_rows).collect()
        assert sorted((x.doc_id is None, x.doc_id or 0, x.n_chars) for x in got) == sorted((d is None, d or 0, len(t)) for d, t in plain)
        by = {}
        for d, t in plain:
            by.setdefault(d, []).append(t)
        order = sorted((d for d in by if d is not None), reverse=True) + [None]
        for k, d in enumerate(order):
            if len(by[d]) == 1:
                after = by[order[(k + 1) % len(order)]] if k + 1 < len(order) else by[order[0]]
                own = by[d][0]
                options = {sha256(fingerprints.edited(own, t).encode()).hexdigest() for t in after}
                assert next(x.edited_sha256 for x in got if x.doc_id == d) in options
        assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    alone = fingerprints.compared(docs.limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprints.compared(docs.limit(0)).count() == 0


def test_likeness():
    f = lambda t: fingerprints.fingerprint(t, fingerprints.Powers())
    text = " ".join(f"word{k * k}" for k in range(300))
    assert fingerprints.likeness(f(text), f(text)) == 1 and fingerprints.likeness(f(text), f(text[:-9] + "x")) > 0.8
    assert fingerprints.likeness(f(text), f("y" * 3)) == 0 and re.match(r"^\d+:[^:]*:[^:]*$", f(text))
