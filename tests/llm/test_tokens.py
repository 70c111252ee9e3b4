import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm.shapes import ROWS, odd, rows_of
from pitwall.llm.packing import best_fit, pack, pack_documents
from pitwall.llm.tokenfiles import read_tokens, token_table, write_tokens
from pitwall.llm.tokens import Encoder

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
_plain = {k: Tokenizer.from_file(public_tokenizers.path(f)) for k, f in FILES.items()}
_quick = {k: Encoder(public_tokenizers.path(f), k) for k, f in FILES.items()}
for t in _plain.values():
    t.encode_special_tokens = True


def ids(kind, text):
    return _plain[kind].encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(sorted(FILES)), st.lists(st.one_of(
    st.text(max_size=12), st.sampled_from(["'s", " 've", "  ", "\n\n", "\r\n ", "\x1c", "\x85", "\xa0", "²", "µ", "é", "é",
                                           "<|endoftext|>", "12", "Wort.", " don't", "¿", "\xad", "İ"])), max_size=8))
def test_ids_are_the_library_s(kind, parts):
    text = "".join(parts)
    assert np.frombuffer(_quick[kind].encode([text])[0], _quick[kind].dtype).tolist() == ids(kind, text)


def test_encoder_forgets_words():
    e = Encoder(public_tokenizers.path(FILES["byte"]), "byte")
    e.MAX_WORDS = 3
    for t in ("a b c d e f", "a b", "x y z a b", ""):
        assert np.frombuffer(e.encode([t])[0], e.dtype).tolist() == ids("byte", t)


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path(FILES["byte"])
    want, at = [], 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r in order:
        x = ids("byte", r[1] or "") + [2]
        want.append((r[0], at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert rows_of(token_table(odd(spark), path)) == sorted(want, key=repr)
    root = f"file://{tmp_path}/tokens"
    manifest = write_tokens(odd(spark), root, path)
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == at
    assert rows_of(read_tokens(manifest, root, "<u2", block=5)) == sorted(want, key=repr)
    assert token_table(odd(spark).limit(0), path).count() == 0


@pytest.mark.parametrize("options", [{}, {"per_group": 2, "fan_in": 2}, {"per_group": 3, "fan_in": 2, "slack": 0}])
def test_packing(spark, options):
    path = public_tokenizers.path(FILES["word"])
    got = pack_documents(odd(spark), path, capacity=64, **options).toPandas()
    want = []
    for r in ROWS:
        x = ids("word", r[1] or "") + [1]
        want += [(r[0], i // 64, i, len(x[i:i + 64]), zlib.crc32(np.array(x[i:i + 64], "<u4").tobytes()))
                 for i in range(0, len(x), 64)]
    pieces = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(pieces, key=repr) == sorted(want, key=repr)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert pack_documents(odd(spark).limit(0), path).count() == 0


def test_few_sequences(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 300, 4000))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(df, 1000, per_group=500, fan_in=4)
    assert got.count() == 4000
    assert got.select("sequence_id").distinct().count() <= 1.02 * sum(r[3] for r in rows) / 1000


def test_best_fit_takes_the_fullest_bin():
    assert best_fit(np.array([6, 5, 4, 5, 3, 1]), 10).tolist() == [0, 1, 0, 1, 2, 2]
