"""Token files: ids against the library on whole texts, the files' layout, selective reads, odd rows."""

import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftloom.llm import token_files
from driftloom.llm.vocab import byte_level, pieces_of_words, vocabulary

TEXTS = [
    "", " ", "  two  spaces ", "plain words here.", "don't we'll I'm 'sup x's.", "a\n\nb \n c\t d", "tail space ", " 　 wide   y", "x  y  z",
    "ünïcode — wörds 漢字かな \U0001f600 mixed", "日本語" * 300, "a" * 5000, "A" * 3000 + "b", "<|endoftext|> in <|endoftext|>text", "▁ marks ▁▁x y▁ z", "1234 5,678.90 (ok) [x];y:z!", "\x00 nul \x1c sep \x85 next",
    " ".join(f"w{i % 97}," for i in range(4000)), "end.", "é combining ́x", " lead", "x  y   z    w", "<s> </s> <unk> <0x41>", "größe Àpropos œuvre ǅ ªº µm Ünï naïve", "l'été d'ici we're",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("special", [True, False])
def test_byte_level_pieces_give_the_ids_of_whole_texts(library, special):
    library.encode_special_tokens = not special
    want = [library.encode(x, add_special_tokens=False).ids for x in TEXTS]
    encode = byte_level(vocabulary("byte_bpe_50k.json"), special)
    for _ in range(2):  # the second time from memory
        flat, before = encode([x.encode() for x in TEXTS])
        assert [flat[a:b].tolist() for a, b in zip(before, before[1:])] == want
    library.encode_special_tokens = False


def test_word_pieces_give_the_ids_of_whole_texts():
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    texts = [x for x in TEXTS if x]
    flat, before = pieces_of_words(vocabulary("piece_bpe_32k.model"))([b" " + x.encode() for x in texts])
    assert [flat[a:b].tolist() for a, b in zip(before, before[1:])] == s.encode(texts)


def test_memory_is_bounded():
    from driftloom.llm.vocab import Encoder

    e = Encoder(lambda xs: [[len(x)] for x in xs], marks=False, memo=50)
    for i in range(100):
        e([b" ".join(b"%d" % j for j in range(i * 10, i * 10 + 10))])
    assert len(e.young) + len(e.old) <= 130
    flat, before = e([b"x" * 100, b"", b"a b"])
    assert flat.tolist() == [100, 1, 2] and before.tolist() == [0, 1, 1, 3]


def brute(rows, library):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf_dir, docs, library):
    got = [tuple(r) for r in token_files.query(spark, sf_dir).collect()]
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(got) == brute(rows, library)


def test_odd_rows(spark, odd_docs, library, tmp_path):
    folder = f"{tmp_path}/odd"
    token_files.write(odd_docs, folder)
    got = [tuple(r) for r in token_files._placed(token_files.checksums(token_files.read(spark, folder)), token_files.read(spark, folder)).collect()]
    rows = odd_docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert sorted(got, key=lambda x: x[1]) == brute([(r.doc_id, r.text) for r in rows], library)


def test_empty_table_and_one_hot_id(spark, no_docs, tmp_path):
    token_files.write(no_docs, f"{tmp_path}/none")
    assert token_files.positions(spark, f"{tmp_path}/none").count() == 0
    hot = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    token_files.write(hot, f"{tmp_path}/hot")
    read = token_files.read(spark, f"{tmp_path}/hot")
    assert read.groupBy("part").count().count() > 1
    got = token_files.positions(spark, f"{tmp_path}/hot").orderBy("start").collect()
    assert [r.start for r in got] == [3 * i for i in range(3000)]


def test_files_allow_selective_reads(spark, docs, tmp_path, capsys):
    folder = f"{tmp_path}/files"
    token_files.write(docs, folder)
    for path in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema.split(".")[0]: c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))}
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert "RLE_DICTIONARY" in columns["ids"].encodings
            assert {"DELTA_BINARY_PACKED"} == {e for c in ("doc_id", "offset", "n_tokens") for e in columns[c].encodings}
    some = token_files.documents_between(spark, folder, 10, 12)
    assert sorted(r.doc_id for r in some.collect()) == [10, 11, 12]
    some.explain()
    assert "GreaterThanOrEqual(doc_id,10)" in capsys.readouterr().out
    token_files.positions(spark, folder).explain()
    plan = capsys.readouterr().out
    assert "ids:array" not in plan
