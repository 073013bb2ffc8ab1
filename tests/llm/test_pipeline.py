import random

from llm_texts import prose

import corpus_pipeline
from ledgerview.llm import decontaminate, line_dedup, packing, quality_rules, simhash_dedup


def test_pipeline_equals_its_parts(spark, tmp_path):
    rnd = random.Random(8)
    bench = [" ".join(f"{rnd.choice('bdfgklmnprst')}{rnd.choice('aeiou')}{k}{rnd.choice('aeiou')}q" for k in range(25)) + "." for _ in range(4)]
    texts = [prose(rnd, 150) for _ in range(30)]
    texts[3] = texts[3] + "\n" + bench[1]
    texts += [texts[0], "JUNK!! MORE!! LOUD!! " * 20, None, texts[5] + "\nOne more closing line of plain words."]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "decontaminate", "packing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert 3 not in set(out.doc_id) and 31 not in set(out.doc_id) and 32 not in set(out.doc_id)
    assert set(range(30)) - {3} <= set(out.doc_id)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for f in (quality_rules, line_dedup, simhash_dedup, decontaminate):
        docs = f.stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = packing.cut_pieces(docs, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken").toPandas()
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))
