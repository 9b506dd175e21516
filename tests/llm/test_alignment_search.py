"""Token alignment and ranked search (operators 11 and 12) against brute force and the libraries."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pathglass.llm import ranked_search, token_alignment
from pathglass.llm.bpe_fst import byte_letters

JSON, MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    counted = [(i, Counter(brute_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(brute_terms(text)) if w in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard_bytes", "k"), [(1 << 24, 10), (3_000, 3), (1, 2)])
def test_search_equals_brute_force(spark, frame, prose, shard_bytes, k):
    r = random.Random(11)
    words = " ".join(t for _, t in prose if t).split()
    docs = [*prose, (None, prose[3][1]), (3, prose[5][1]), (3, prose[5][1]), (-4, "ÉTÉ été éTé"), (2**62, "tie tie"), (2**62 - 1, "tie tie"), (5, "A1b2-c3_d4")]
    items = [(k, " ".join(r.choices(words, k=12))) for k in range(12)] + [(3, "tie"), (3, "a1B2 C3 d4"), (None, "été tie"), (50, None), (51, ""), (52, "?!"), (53, "nowhereatall"), (54, "tie tie")]
    got = ranked_search.ranked_search(frame(docs), frame(items).withColumnRenamed("doc_id", "item_id"), k, shard_bytes=shard_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, k)


def test_search_of_nothing(spark, frame, prose):
    items = frame(prose[:3]).withColumnRenamed("doc_id", "item_id")
    for docs, asked in ((frame([]), items), (frame(prose), items.limit(0)), (frame([(1, None), (2, "!?")]), items)):
        assert ranked_search.ranked_search(docs, asked).count() == 0


def test_items_beyond_a_block_and_terms_beyond_the_broadcast(spark, frame, prose, monkeypatch):
    monkeypatch.setattr(ranked_search, "HOT_KEYS", 0)
    items = [(k, t) for k, t in prose[:40] if t]
    index = ranked_search.build_index(frame(prose), shard_bytes=4_000)
    got = ranked_search.search(index, frame(items).withColumnRenamed("doc_id", "item_id"), block=7)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(prose, items)


def test_merge_prunes_without_losing_ties():
    r = np.random.default_rng(4)
    for _ in range(200):
        n, k = int(r.integers(1, 60)), int(r.integers(1, 6))
        whole = np.zeros(n, np.int64)
        lists = []
        for _ in range(int(r.integers(1, 8))):
            at = np.flatnonzero(r.random(n) < r.random())
            gain = r.integers(0, 4, len(at)) * int(r.integers(1, 5))
            whole[at] += gain
            lists.append(ranked_search.PostingList(at, gain, k))
        want = sorted(((int(s), d) for d, s in enumerate(whole) if s > 0), key=lambda e: (-e[0], e[1]))[:k]
        assert ranked_search.best_documents(lists, k) == want


def test_postings_round_trip():
    r = np.random.default_rng(5)
    for top in (200, 60_000, 1 << 31):
        at, tf = np.unique(r.integers(0, top, 300)), r.integers(1, top, 300)
        back = ranked_search.unpack_postings(ranked_search.pack_postings(at, tf[: len(at)]), len(at))
        assert back[0].tolist() == at.tolist() and back[1].tolist() == tf[: len(at)].tolist()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = byte_letters()
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not b"".join(map(spell_a, left)) == b"".join(map(spell_b, right)) == (" " + text).encode():
            return []
        out, x, y = [], 0, 0
        for i in left:
            x += len(spell_a(i))
            if not out or done:
                out.append(([], []))
            out[-1][0].append(i)
            while y < x and right:
                out[-1][1].append(right[0])
                y += len(spell_b(right.pop(0)))
            done = x == y
        return out

    return groups


def brute_alignment(rows, groups):
    found = [(i, groups(t)) for i, t in rows]
    pairs = [[(x, y) for g in gs for x in g[0] for y in g[1]] for _, gs in found]
    held = Counter(p for ps in pairs for p in set(ps))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for (i, gs), ps in zip(found, pairs, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(ps), sum(held[p] == best[p[0]] for p in ps), sum(map(held.__getitem__, ps)), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def odd(prose):
    r = random.Random(12)
    return [*prose, (3, prose[3][1]), (None, "no id"), (None, None), (70, "a▁b"), (71, "<s> </s> <unk> <0x41>"), (72, "  two  spaces   three\n\n\t x"), (73, "\x00\x01 null"), (74, "x" * 3000), (75, "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(400))), (76, "👩‍👩‍👧 é é"), (77, " "), (78, "end ")]


def test_alignment_equals_brute_force(spark, odd, libraries, tmp_path):
    data = [(i, t, *("x" * 3)) for i, t in odd]
    spark.createDataFrame(data, "doc_id long, text string, row string, pair string, id string").write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    got = token_alignment.align_tokens(docs, JSON, MODEL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_alignment(odd, libraries)
    listed = token_alignment.aligned_groups(docs, JSON, MODEL).orderBy("row", "number").collect()
    by_row = {}
    for g in listed:
        by_row.setdefault(g.row, []).append((list(g.a_ids), list(g.b_ids)))
    assert sorted(by_row.values(), key=repr) == sorted((gs for gs in (libraries(t) for _, t in odd) if gs), key=repr)
    assert token_alignment.align_tokens(docs.limit(0), JSON, MODEL).count() == 0


def test_small_blocks_large_groups_and_shuffled_pairs(spark, odd, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "PAIRED", 2)
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(token_alignment, "end_events", lambda *x, whole=token_alignment.end_events: whole(*x, events=3))
    docs = spark.createDataFrame(odd, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, token_alignment.align_tokens(docs, JSON, MODEL).collect()), key=repr) == brute_alignment(odd, libraries)


def test_sweep_holds_the_open_group_alone():
    widths = (np.array([0, 1, 2]), np.array([0, 1, 3]))
    machine = token_alignment.Sweep(widths)
    assert machine.feed(0, 2, np.array([2, 2, 2], np.uint32)) is None
    got = machine.feed(1, 3, np.array([2, 1], np.uint32))
    assert (got.ends.tolist(), got.a.tolist(), got.n_a.tolist(), got.b.tolist(), got.n_b.tolist()) == ([4], [2, 2], [2], [2, 1], [2])
    assert [len(x) for x in machine.ids] == [1, 0]
