import hashlib
import random

import sentencepiece

from souklens.llm.pieces import ChunkTable, default_model, digests, encode_pieces

TEXTS = ["Hello world", "  two  spaces ", "a\nb", "▁x", "", " ", "\n", "é漢字🙂", "a\x00b", "x ▁ y", "<s> hi </s> <unk> <0x0A>", "a b　c ", "tab\tx", " \n \n", "\n\n  a", "a▁▁b ▁", "x" * 3000, "é ​|\\|"]


def test_equals_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice([" ", "  ", "\n", "ab", "é", "the", "▁", "🙂", ".", "\t", "ing"]) for _ in range(r.randint(1, 60))) for _ in range(300)]
    rows = [(k, t, "own") for k, t in enumerate(texts)] + [(None, None, None)]
    df = encode_pieces(spark.createDataFrame(rows, "doc_id long, text string, ids string"), bound=50)
    for x in df.select("doc_id", "text", "ids", "decoded", *digests(df)).collect():
        ids = sp.encode(x.text or "")
        assert x.ids == ids and x.decoded == sp.decode(ids) and x.n_tokens == len(ids), x.text
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert encode_pieces(df.select("doc_id", "text").limit(0)).count() == 0


def test_table_is_bounded():
    t = ChunkTable(default_model(), bound=3)
    for k in range(5):
        t.encode([f"w{k} x{k} y{k} z{k}"])
        assert len(t.number) <= 4
