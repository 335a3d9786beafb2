import random

from pertscope.plans.catalog import QUERIES


def test_every_document_is_searched(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, " ".join(f"t{rng.randrange(40)}" for _ in range(rng.randint(1, 30))), "en", "web", 1) for k in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    from hashlib import md5
    bits = [{int(md5(w.encode()).hexdigest()[:8], 16) % 2048 for w in r[1].split(" ")} for r in rows]
    want = {}
    for q in range(0, 160, 50):
        far = sorted((1 - len(bits[q] & b) / len(bits[q] | b), k) for k, b in enumerate(bits) if k != q)[:10]
        want |= {(q, n): (k, round(x, 6)) for n, (x, k) in enumerate(far, 1)}
    got = {(r.query_id, r["rank"]): (r.ref_id, round(r.distance, 6))
           for r in QUERIES["tanimoto_nearest"](spark, str(tmp_path)).collect()}
    assert got == want
