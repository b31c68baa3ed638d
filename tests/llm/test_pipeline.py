"""The pipeline's stages in order on a small corpus, each against what it must do."""

from collections import Counter
from hashlib import md5
from math import ceil, exp
from pathlib import Path
import random

import corpus_pipeline
import numpy as np

from test_tokens import check_pieces

from turnengine.llm import common, packing, secret_scan
from turnengine.llm import simhash as S

DATA = Path("/root/testdata")


def plain_near(rows):
    """doc_ids that stay: the smallest of each group of texts whose sets of five-word shingles are alike at 0.8."""
    sets = [(i, frozenset(S.shingle_hashes(None if t is None else t.encode(), 5).tolist())) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {find(i) for i, _ in sets}


def plain_mix(rows):
    """How often each doc_id occurs in the mixed corpus: Poisson draws by inversion, written out."""
    chars = Counter()
    for _, text, source in rows:
        chars[source] += len(text or "")
    weight = {s: c**0.5 for s, c in chars.items()}
    out = Counter()
    for i, _, source in rows:
        rate = weight[source] / sum(weight.values()) * sum(chars.values()) / chars[source] if chars[source] else 1.0
        draws = max(1, ceil(rate / 16))
        step = rate / draws
        for part in range(1, draws + 1):
            u = int(md5(f"mix-1:{'null' if i is None else i}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            p = upto = exp(-step)
            k = 0
            while upto <= u and k < 95:
                k += 1
                p *= step / k
                upto += p
                out[i] += 1
    return out


def test_odd_documents(spark, make_docs, odd_rows, tmp_path):
    """Nulls, empties, repeats, a very long text, columns with clashing names; then no documents at all."""
    for name, rows in (("odd", [*odd_rows, (7, "a b c d e f"), (9, None, None), (10, "token = 0123456789abcdef0123456789abcdef", None)]), ("none", [])):
        folder = f"{tmp_path.as_uri()}/{name}"
        make_docs(rows, extra=True).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 0), (4, 1, 0)][: 9 * bool(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns, results = docs.columns, []
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
            results.append(docs)
        assert all(r.columns == columns for r in results[:4])
        clean, once, masked, mixed, packed = [r.collect() for r in results]
        assert len(clean) == len(rows)
        assert sorted(r.doc_id for r in once if r.doc_id is not None) == sorted(plain_near([(r[0], r[1]) for r in rows]))
        assert sum(r.doc_id is None for r in once) == sum(r[0] is None for r in rows) and len(masked) == len(once)
        assert Counter(r.doc_id for r in mixed) == plain_mix([(r.doc_id, r.text, r.source) for r in masked])
        check_pieces(packed, [(r.doc_id, r.text) for r in mixed], packing.Limits())


def test_stages(spark, make_docs, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 7)))
    texts = [[word() for _ in range(rng.randint(60, 150))] for _ in range(400)]
    toxic = {i for i in range(400) if i % 8 == 0}
    for i in toxic:
        for _ in range(4):
            texts[i].insert(rng.randrange(len(texts[i])), rng.choice(["vilewort", "nastix", "grobian"]))
    rows = [(i, " ".join(t), "s" + str(i % 3)) for i, t in enumerate(texts)]
    copies = [(1000 + i, rows[i][1], "s0") for i in range(1, 60) if i not in toxic]
    secret = [(2000, rows[1][1] + " fresh words token = 0123456789abcdef0123456789abcdef " + " ".join(word() for _ in range(100)), "s1")]
    folder = tmp_path.as_uri()
    make_docs([*rows, *copies, *secret]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    results = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        results.append(docs)
    clean, once, masked, mixed, packed = results
    assert all(r.columns == columns for r in results[:4])
    left = {r.doc_id for r in clean.collect()}
    assert not left & toxic and len(left) >= 0.99 * (len(rows) + len(copies) + 1 - len(toxic))
    kept = {r.doc_id for r in once.collect()}
    assert kept == {i for i in left if i < 1000 or i == 2000 or rows[i - 1000][0] not in left}
    assert kept == plain_near([(r.doc_id, r.text) for r in clean.collect()])
    assert Counter(r.doc_id for r in mixed.collect()) == plain_mix([(r.doc_id, r.text, r.source) for r in masked.collect()])
    assert masked.count() == once.count() and all(secret_scan.scan(r.text)[0] == [] for r in masked.collect())
    assert {r.doc_id for r in mixed.collect()} <= kept and abs(mixed.count() - len(kept)) < 0.25 * len(kept)
    assert sum(p.length for p in packed.collect()) > 0
    check_pieces(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()], packing.Limits())


def test_run(spark):
    shared = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    pieces = corpus_pipeline.run(spark, f"{DATA}/sf0.001").toPandas()
    assert [p.name.split("-")[1] for p in set(shared.iterdir()) - before] == ["packing"]  # nothing else is left
    sizes = pieces.groupby("sequence_id").length.sum().to_numpy()
    assert (np.bitwise_count(sizes.astype(np.uint64)) == 1).all() and sizes.max() == 2048
