"""The pipeline and each of its stages against plain versions, with every edge case in one table."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from folioforge.llm import mixing, toxicity

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copy string, score double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = prose(25)
    texts = [prose(rng.randint(20, 90)) for _ in range(120)]
    for i in range(30):
        near = texts[i].split()
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near) if i % 2 else texts[i])
    texts += [f"{prose(30)} {item} {prose(9)}" for _ in range(6)]
    texts += [" ".join(rng.sample([*prose(12).split(), "idiot", "you", "moron", "stupid", "pathetic"], 17)) for _ in range(60)]
    texts += [None, "", " \t", "one", prose(4000)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 1, "c", 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[-4], rows[-4], (None, texts[5], "en", "s1", 1, "c", 0.5), (None, texts[5], "en", "s1", 1, "c", 0.5)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("moron" in (t or "").split() or "idiot" in (t or "").split())) for i, t in enumerate(texts) if i % 5]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def kept(frame):
    assert frame.columns[:7] == [c.split()[0] for c in COLUMNS.split(", ")]
    return Counter(tuple(r)[:7] for r in frame.collect())


def near_duplicates_gone(rows):
    sets = []
    for r in rows:
        w = SPACED.findall((r[1] or "").translate(FOLD))
        sets.append(None if r[0] is None or not w else {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = [r[0] for r in rows]
    for _ in rows:
        new = list(root)
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    new[a] = min(new[a], root[b])
        if new == root:
            break
        root = new
    out, seen = Counter(), set()
    for r, x, k in zip(rows, sets, root):
        if x is None or (k == r[0] and r[:2] not in seen):
            out[r] += 1
            seen.add(r[:2])
    return out


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = pipeline.drop_toxic(spark, docs, folder)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    low = {r["text"] for r in docs.join(toxicity.score(docs.select("doc_id", "text"), model).where("predicted = 1").select("doc_id"), "doc_id").collect()}
    assert kept(clean) == Counter(r for r in rows if r[1] not in low) and len(low) > 40
    single = pipeline.drop_near_duplicates(spark, docs, folder)
    assert kept(single) == near_duplicates_gone(rows)
    w = lambda t: ALNUM.findall((t or "").translate(FOLD))
    item = w(spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first()["text"])
    windows = {tuple(item[j : j + 10]) for j in range(len(item) - 9)}
    hit = lambda t: any(tuple(w(t)[j : j + 10]) in windows for j in range(len(w(t)) - 9))
    assert kept(pipeline.drop_contaminated(spark, docs, folder)) == Counter(r for r in rows if not hit(r[1]))
    taken = kept(pipeline.mix_sources(spark, docs, folder))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(SPACED.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.fill_targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()), 2)))
    for r, n in Counter(rows).items():
        assert taken[r] == n if not SPACED.findall(r[1] or "") else taken[r] <= 2 * n
    for s in order:
        assert abs(sum(n * len(SPACED.findall(r[1] or "")) for r, n in taken.items() if r[3] == s) - targets[s]) <= 60
    assert taken == kept(pipeline.mix_sources(spark, docs.repartition(5), folder))
    sharded = pipeline.assign_shards(spark, docs, folder)
    assert kept(sharded) == Counter(rows) and "shard" in sharded.columns


def test_run(spark, tables):
    folder, rows = tables
    out = pipeline.run(spark, folder)
    got = kept(out)
    assert set(got) <= set(rows) and len(got) > 80
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        step = stage(spark, step, folder).cache()
    assert got == kept(step)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_empty_documents(spark, tables, tmp_path):
    folder, _ = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
