import __spark_entry__
import corpus_pipeline
from lexmill.llm.common import BitFilter, Memo


def test_stages(spark, tmp_path):
    text = " ".join(f"word{i} of the long clean river house" for i in range(40))
    item = "which stone lies under the green light of the old water house by the river gate"
    rows = [
        (1, text, "en", "a", 1),
        (2, text, "en", "a", 1),
        (3, text.replace("word7 ", "wordx ", 1), "fr", "b", 1),
        (4, "1234 5678", "en", "a", 9),
        (5, None, "en", "a", 0),
        (6, "Some opening words stand here.\n" + item + "\nand something else follows after it", "en", "a", 1),
        (7, "A clean text that is like no other text in this small table", None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        kept.append({r.doc_id for r in now.collect()})
    assert kept[0] == kept[1] == {1, 2, 3, 6, 7}
    assert 1 in kept[2] and 2 not in kept[2] and {6, 7} < kept[2]
    assert kept[3] == kept[2] - {6}
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in done} == kept[3] and all(r.n_tokens > 0 for r in done)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_bit_filter_and_memo(spark):
    keys = spark.range(-500, 500, 3)
    found = BitFilter(keys, "id")
    import numpy as np

    some = np.arange(-500, 500)
    assert set(some[found.passes(some)]) == set(range(-500, 500, 3))
    memo = Memo(lambda k: k * 2, 3)
    assert [memo[k] for k in (1, 2, 3, 4, 1, 5, 6, 7, 1)] == [2, 4, 6, 8, 2, 10, 12, 14, 2] and len(memo) <= 3
