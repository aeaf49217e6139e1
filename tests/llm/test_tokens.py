"""Token counts, packing and token files against the tokenizers library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from walkweave.llm import token_files as files
from walkweave.llm.common import shared_folder
from walkweave.llm.packing import Packer, pack
from walkweave.llm.pretokens import Pretokens
from walkweave.llm.token_counts import token_counts


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


ALPHABET = st.sampled_from([*"aBs'tx \n\t1½²éÉΣςİǅ中!$_", "'re", "'LL", "  ", " ", "́", "​", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c"])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=25).map("".join))
def test_cut_agrees_with_library(byte_bpe, word_bpe, text):
    tool = _tool(byte_bpe, False)
    assert next(iter(tool.encode([text]))).tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids
    tool = _tool(word_bpe, True)
    segments, special = tool.segments(text)
    words, number, counts = tool.cut(segments)
    assert counts.sum() == len(number)
    assert len(special) + sum(len(tool.pieces(words[k])) for k in number) == len(tool.tokenizer.encode(text, add_special_tokens=False).ids)


_TOOLS = {}


def _tool(path, words):
    if path not in _TOOLS:
        _TOOLS[path] = Pretokens(path, words)
    return _TOOLS[path]


@pytest.mark.parametrize("hot", [0, 2, 9, 1000])
def test_token_counts(odd, word_bpe, hot):
    tok = Tokenizer.from_file(word_bpe)
    want = Counter()
    for r in odd.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 2048] += 1
    assert Counter(tuple(r) for r in token_counts(odd, word_bpe, hot=hot).collect()) == want
    assert any(k[3] for k in want)


def test_token_counts_empty(none, word_bpe):
    assert token_counts(none, word_bpe).collect() == []


def check_packing(rows, texts, path, top=1024):
    """Pieces cover every document once, sequences are gapless and end full or at a power of two."""
    want = Counter()
    for t in texts:
        ids = np.array(ids_of(path, t) + [0], "<u4")
        want[len(ids), zlib.crc32(ids.tobytes())] += 1
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= top and at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(n * c for (n, _), c in want.items())


def test_packing(odd, byte_bpe):
    rows = pack(odd, byte_bpe, block=4).collect()
    check_packing(rows, [r.text for r in odd.collect()], byte_bpe)
    ids = np.array(ids_of(byte_bpe, "word " * 3000) + [0], "<u4")
    mine = sorted((r for r in rows if r.doc_tokens == len(ids)), key=lambda r: r.start)
    assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in mine)


def test_packing_empty(none, byte_bpe):
    assert pack(none, byte_bpe).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.integers(1, 9))
def test_packer_keeps_all_and_fills(sizes, block):
    packer, closed = Packer((8, 16, 32, 64), 128), []
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n, dtype="<u4"))
        if k % block == 0:
            packer.pack()
    packer.pack()
    packer.finish()
    loads = Counter()
    for g, size, window in packer.groups():
        loads[g] += size
        closed += window
        assert sum(p[2] for p in window) == size and size & (size - 1) == 0 and size <= 64
    for k, n in enumerate(sizes):
        at = 0
        for _, start, length, crc in sorted(p for p in closed if p[0] == k):
            assert start == at and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
            at += length
        assert at == n
    if loads:
        assert max(loads.values()) - min(loads.values()) <= 64


def test_token_files_round_trip(spark, odd, byte_bpe):
    folder = shared_folder(spark, "token-files")
    manifest = files.write_token_files(odd, byte_bpe, folder, partitions=3, length=64, batch=4)
    rows = files.read_token_files(manifest, length=64, batch=4).collect()
    texts = defaultdict(list)
    for r in odd.collect():
        ids = np.array(ids_of(byte_bpe, r.text) + [2], "<u4")
        texts[r.doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    got, at, last = defaultdict(list), 0, None
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and (last is None or r.doc_id is not None and r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
        got[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_token_file_random_access(tmp_path):
    ids = np.arange(1000, dtype="<u4")
    path = str(tmp_path / "x.arrows")
    with pa.OSFile(path, "wb") as sink:
        out = files.Writer(sink, 16, 4)
        for a in range(0, 1000, 70):
            out.write(ids[a:a + 70])
        out.close()
    with pa.memory_map(path) as source:
        reader = files.Reader(source, 16, 4)
        for k in (61, 0, 37, 5):
            assert reader.sequence(k).tolist() == ids[16 * k:16 * k + 16].tolist()
        assert np.concatenate(list(reader.span(300, 500))).tolist() == ids[300:800].tolist()
    with pa.memory_map(path) as source:
        masks = [b.column("mask").to_pylist() for b in pa.ipc.open_stream(source)]
    assert sum(x for b in masks for s in b for x in s) == 1000 and len({len(s) for b in masks for s in b}) == 1


def test_token_files_empty(spark, none, byte_bpe):
    assert files.token_files(spark, none, byte_bpe).collect() == []
