"""The pipeline on planted cases against a plain version of every stage."""

import random
import re
import zlib

import numpy as np

import corpus_pipeline
from glossa.llm import packing

WORDS = [a + b for a in ("ka", "lo", "mi", "su", "te", "ra", "no", "vi") for b in ("ren", "dal", "mos", "tik", "bur", "fen", "gol", "hap")]
BAD = ("dimwit", "scoundrel", "blockhead")


def prose(rng, n):
    out = []
    while len(out) < n:
        s = [rng.choice(WORDS) for _ in range(rng.randint(5, 12))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out)


def test_planted(spark, tmp_path):
    rng = random.Random(41)
    items = [(i, prose(rng, 30)) for i in range(5)]
    docs, labels, gone, masked = [], [], set(), {}
    for i in range(400):
        text, kind = prose(rng, rng.randint(80, 300)), i % 10
        if kind == 1:
            text += " " + " ".join(f"{rng.choice(WORDS)} {rng.choice(BAD)} {rng.choice(WORDS)}." for _ in range(3))
            gone.add(i)
        elif kind == 2:
            text = docs[i - 2][1]  # a copy of a clean document
            gone.add(i)
        elif kind == 3:
            w = docs[i - 3][1].split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
            gone.add(i)
        elif kind == 4:
            text = f"{text[:200]} {items[i % 5][1]} {text[200:]}"
            gone.add(i)
        elif kind == 5:
            text += f" Mail u{i}@host.example or call +1 (555) 010-{1000 + i} now."
            masked[i] = text
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(kind == 1)))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {p["doc_id"] for p in pieces}
    # Of a clean document and its copies the first stays.
    assert found == {d[0] for d in docs} - gone
    encode = packing.byte_bpe_encoder()
    text = {d[0]: d[1] for d in docs}
    for i in found:
        want = text[i]
        if i in masked:
            want = re.sub(r"\+1 \(555\) 010-\d+", "[PHONE]", re.sub(r"u\d+@host\.example", "[EMAIL]", want))
        ids = np.append(encode(want), 1).astype("<u4")
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert [p["ids_crc32"] for p in mine] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in mine]
        assert sum(p["length"] for p in mine) == len(ids)
