"""The pipeline, stage by stage, against brute force."""
from collections import Counter

import corpus_pipeline as cp
from spendledger.llm import contamination, hyper_language
from spendledger.llm.bin_packing import CAPACITIES
from spendledger.llm.common import WHITE
from test_dedup import brute_components
from test_lines_shards_items_bins import brute_items, brute_lines, check_bins

SF = "/root/testdata/sf0.001"


def ids_and_texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def brute_stages(docs, items, languages):
    """What each stage keeps, from its own input."""
    keep = [d for d, (lang, score) in zip(docs, languages, strict=True) if lang != "und" and score >= cp.LEAST_LIKENESS]
    yield keep
    had = Counter(i for i, t in keep if t and t.strip(WHITE))
    keep = [(i, None if n is None else k) for (i, n), k in zip(keep, [k for (_, k, _, _) in lines_in_order(keep)], strict=True)
            if n is None or k.strip(WHITE) or not had[i]]
    yield keep
    stays = {i for (i, _, _, kept) in brute_components(keep, 5, 80) if kept}
    keep = [d for d in keep if d[0] is None or d[0] in stays]
    yield keep
    leaked = {d for d, _ in brute_items(keep, items)}
    yield [d for d in keep if d[0] not in leaked]


def lines_in_order(rows):
    by = {}
    for i, kept, n, gone in brute_lines(rows):
        by.setdefault(i, []).append((i, kept, n, gone))
    return [by[i][0] for i, _ in rows]


def test_stages_on_a_small_table(spark, make):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 70").collect()]
    rows += [(500, "12 34", "en"), (501, None, "en"), (502, rows[3][1], "en"), (503, rows[4][1] + " tail", "en"), (504, "日本語の文章です", None)]
    docs = make(rows)
    sf = spark.read.parquet(f"{SF}/benchmark.parquet").limit(15)
    items = [(r.item_id, r.text) for r in sf.collect()]
    rows += [(505, f"aaa {items[0][1]} bbb", "en")]
    docs = make(rows)
    languages = hyper_language.learn(docs).predict([t for _, t, _ in rows])
    benchmark = {}

    def fake(spark, d, sf_dir):
        return contamination.remove_contaminated(d, sf)

    for (name, stage), want in zip(cp.STAGES[:3] + [("benchmark", fake)], brute_stages([r[:2] for r in rows], items, languages), strict=True):
        columns = docs.columns
        docs = cp.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns and ids_and_texts(docs) == Counter(want), name
        benchmark[name] = len(want)
    assert benchmark["language"] == len(rows) - 3 and benchmark["benchmark"] < benchmark["near_copies"]
    lengths = Counter()
    for i, t in want:
        lengths[i] += len((t or "").encode()) + 1
    check_bins(cp.packed(spark, docs, SF).collect(), lengths, CAPACITIES)


def test_whole_table_and_empty(spark, make):
    rows = cp.run(spark, SF).collect()
    assert rows and cp.ORACLE_SQL is None and len(cp.STAGES) == 5
    docs = make([])
    for name, stage in cp.STAGES:
        docs = cp.materialise(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_other_scripts_are_dropped_and_short_texts_kept(spark, make):
    """Texts that share no trigram with the profiles go; clean texts of a few words stay."""
    other = ["Η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει στο δάσος", "今天天气很好我们一起去公园散步然后回家吃饭看书",
             "Быстрая коричневая лиса прыгает через ленивую собаку и бежит в лес", "สวัสดีครับวันนี้อากาศดีมากเราไปเดินเล่นกันเถอะ",
             "שלום עולם זה משפט קצר בשפה אחרת לגמרי", "नमस्ते दुनिया यह एक छोटा वाक्य है"]
    clean = ["the and of the", "and that the", "der und die das", "les des pour par", "el de la que"]
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + k, t, None) for k, t in enumerate(other)] + [(20_000 + k, t, None) for k, t in enumerate(clean)]
    got = {r.doc_id for r in cp.known_language(spark, make(rows), SF).collect()}
    assert got == {r[0] for r in rows} - {10_000 + k for k in range(len(other))}
