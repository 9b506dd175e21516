"""BPE transducer, counts, codec, Elias-Fano files (operators 3, 4, 8)."""

import base64
import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathglass.llm import bpe_codec, bpe_fst, common, token_counts, token_store
from pathglass.llm.bpe_fst import SPLIT_PATTERN, TextEncoder, Transducer, Utf8Decoder, encoder, load_vocabulary
from pathglass.llm.elias_fano import EliasFano

RANKS, JSON = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "/opt/tokenizers/byte_bpe_50k.json"
TEXT = st.text(st.one_of(st.sampled_from("ab etd'sl19 \n\t.,é 日😀"), st.characters(max_codepoint=0x24F)), max_size=60)


@pytest.fixture(scope="module")
def rank_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def json_library():
    return Tokenizer.from_file(JSON)


def unpack(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_transducer_equals_the_rank_library(rank_library, text):
    ids = unpack(encoder(RANKS).encode(text))
    assert ids == rank_library.encode_ordinary(text)
    decoder = Utf8Decoder(load_vocabulary(RANKS))
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text


@settings(max_examples=300, deadline=None)
@given(TEXT.map(lambda t: t.replace("19", "<|endoftext|>")))
def test_transducer_equals_the_json_library(json_library, text):
    want = json_library.encode(text, add_special_tokens=False).ids
    assert unpack(encoder(JSON).encode(text)) == want
    assert encoder(JSON).count(text) == len(want)
    assert unpack(token_store._encode(JSON, text)) == want


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_state_maps_compose_to_the_whole_count(text, chunk):
    enc = encoder(JSON)
    assert token_counts.count_text(text, enc, chunk) == enc.count(text)
    maps = [token_counts.state_map(text[k : k + chunk], enc) for k in range(0, len(text), chunk)]
    for n in range(1, len(maps) + 1):
        assert token_counts.apply_to_start(token_counts.up_sweep(maps[:n], enc), enc) == enc.count(text[: n * chunk])
    for k in range(len(maps) - 2):
        a, b, c = maps[k : k + 3]
        left, right = token_counts.compose(token_counts.compose(a, b, enc), c, enc), token_counts.compose(a, token_counts.compose(b, c, enc), enc)
        assert token_counts.apply_to_start(left, enc) == token_counts.apply_to_start(right, enc)


@pytest.mark.parametrize("kind", ["letters", "mixed", "spaced", "far"])
def test_long_pieces_stay_bounded_and_equal_the_libraries(kind, rank_library, json_library):
    r = random.Random(17)
    alphabet = {"letters": "etaoinshrdlu", "mixed": "ab1.é日", "spaced": "abc de ", "far": "日本語テキスト"}[kind]
    text = "".join(r.choices(alphabet, k=150_000 if kind != "spaced" else 60_000))
    small = TextEncoder(load_vocabulary(JSON), 0.01)
    want = json_library.encode(text, add_special_tokens=False).ids
    assert token_counts.count_text(text, small) == len(want)
    assert len(small.fst.states) <= 1_300 and len(small.fst.pairs) <= 2_501
    ranks = TextEncoder(load_vocabulary(RANKS), 0.01)
    assert unpack(ranks.encode(text[:20_000])) == rank_library.encode_ordinary(text[:20_000])
    tracemalloc.start()
    assert token_counts.count_text(text, small) == len(want)
    packed = small.encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert unpack(packed) == want
    assert peak < 24 * len(text.encode()) + (20 << 20)


def test_characters_that_libraries_class_differently(json_library):
    differ = [c for c in map(chr, range(0x180, 0x3000)) if not bpe_fst._alike[c]]
    for c in differ[:40] + ["\u0558", "\u058b", "\u088f"]:
        text = f" {c}'s a{c}b 1{c}2 {c}{c} .{c}"
        want = json_library.encode(text, add_special_tokens=False).ids
        assert unpack(encoder(JSON).encode(text)) == unpack(token_store._encode(JSON, text)) == want and encoder(JSON).count(text) == len(want)


def test_tables_of_the_transducer_stay_bounded():
    fst, r = Transducer(load_vocabulary(RANKS), max_states=50, max_pairs=50), random.Random(1)
    big = Transducer(load_vocabulary(RANKS))
    for _ in range(300):
        piece = "".join(r.choice("abcdefgh tion") for _ in range(12)).encode()
        assert fst.encode(piece) == big.encode(piece)
        assert len(fst.states) <= 52 and len(fst.pairs) <= 51


def test_malformed_bytes_decode_like_replace():
    v, r = load_vocabulary(RANKS), random.Random(2)
    for _ in range(500):
        data = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(9))
        d = Utf8Decoder(v)
        assert "".join(d.feed([v.ids[bytes([b])]]) for b in data) + d.finish() == data.decode("utf-8", "replace")


def test_counts_and_codec_cover_every_row(spark, frame, prose, rank_library, json_library):
    rows = [*prose, (None, "no id"), (3, "twice"), (3, "twice")]
    counted = sorted(map(tuple, token_counts.token_counts(frame(rows), JSON, chunk=64).collect()), key=repr)
    assert counted == sorted(((i, len((t or "").encode()), n := len(json_library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows), key=repr)
    coded = sorted(map(tuple, bpe_codec.round_trip_digests(frame(rows), RANKS).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := rank_library.encode_ordinary(t or "")), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())) for i, t in rows]
    assert coded == sorted(want, key=repr)
    back = bpe_codec.decode_ids(bpe_codec.encode_texts(frame(rows), RANKS), RANKS)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert bpe_codec.round_trip_digests(frame([]), RANKS).count() == token_counts.token_counts(frame([]), JSON).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, (1 << 64) - 1)), max_size=300))
def test_elias_fano_selects_what_went_in(values):
    values = sorted(values)
    ef, end = EliasFano.from_bytes(b"abc" + EliasFano.build(np.array(values, np.uint64)).to_bytes() + b"xyz", 3)
    assert values == [ef.select(i) for i in range(len(values))]
    assert end == 3 + len(EliasFano.build(np.array(values, np.uint64)).to_bytes())


def test_elias_fano_is_near_minimal_and_strict():
    values = sorted(random.Random(3).sample(range(1 << 32), 20_000))
    assert len(EliasFano.build(np.array(values, np.uint64)).to_bytes()) * 8 < 20_000 * (2.6 + 18)
    with pytest.raises(ValueError):
        EliasFano.build([2, 1])
    with pytest.raises(ValueError):
        EliasFano.build([-1, 1])
    with pytest.raises(IndexError):
        EliasFano.build([1]).select(1)


def test_token_files_round_trip(spark, frame, prose, json_library, tmp_path):
    rows = [*prose, (None, "no id"), (None, None), (3, "twice"), (3, "twice"), (-7, "below zero"), (-(2**63) + 5, "far below"), (2**63 - 5, "far above")]
    path = f"file://{tmp_path}/files"
    token_store.write_token_files(frame(rows), JSON, path, file_ids=500)
    got = sorted(map(tuple, token_store.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    start = 0
    for _, at, n, crc, ids in got:
        assert at == start and n == len(ids) // 4 and crc == zlib.crc32(ids)
        start += n
    want = sorted((repr(i), json_library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    assert sorted((repr(r[0]), unpack(r[4])) for r in got) == want
    file = token_store.TokenFile(spark.read.parquet(path).first()["file"])
    for k, (key, _, ids) in enumerate(file.documents()):
        assert file.doc_id(k) == key and file.ids(k).tolist() == ids.tolist()
    assert token_store.token_files_digest(frame([]), JSON).count() == 0


def test_another_operators_task_frees_the_vocabulary(spark, monkeypatch):
    """A worker that goes on to another operator keeps neither the encoder's tables nor the vocabulary (35 MB)."""
    docs, taken = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: taken.append(f) or real(self, f, schema))
    bpe_codec.encode_texts(docs, RANKS)
    bpe_codec.round_trip_digests(docs, RANKS)
    for run in taken:
        batch = pa.RecordBatch.from_pydict({"__id": [1], "__text": ["some words"]})
        assert len(list(run([batch]))) == 1 and load_vocabulary.cache_info().currsize
        with common.task_tables("another operator"):
            assert not load_vocabulary.cache_info().currsize and not encoder.cache_info().currsize
