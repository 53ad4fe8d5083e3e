"""The pipeline's stages, one after the other, on odd rows and against brute force."""

import random
import re

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_columns(spark, odd, tmp_path, labels):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def planted(seed: int = 21) -> tuple[list[tuple], list[tuple], dict[int, int]]:
    """Documents, labels, and for each near copy what it copies."""
    r = random.Random(seed)
    plain = [f"w{k}" for k in range(400)]
    rows, labels, copies = [], [], {}
    for k in range(700):
        words = [r.choice(plain) for _ in range(r.randrange(60, 200))]
        if toxic := k % 4 == 1:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["idiot", "scum", "moron"])
        elif k % 10 == 0:
            words.insert(r.randrange(len(words)), f'api_key = "k{r.randrange(10**9):012d}"')
        rows.append((k, " ".join(words), r.choice(["en", "de"]), f"s{min(r.randrange(9), 4)}", None))
        labels.append((k, 1, int(toxic)))
    for k in range(0, 200, 4):  # clean ones, copied with a word at the end
        copies[len(rows)] = k
        rows.append((len(rows), rows[k][1] + " tail", rows[k][2], rows[k][3], None))
    return rows, labels, copies


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels, copies = planted()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, DOCS)
    toxic = {k for k, _, t in labels if t}

    def step(stage, docs):
        out = stage(spark, docs, str(tmp_path)).collect()
        return {r[0]: r for r in out}, spark.createDataFrame(out, DOCS), out

    kept, docs, _ = step(corpus_pipeline.drop_toxic, docs)
    assert len(toxic & set(kept)) <= 0.02 * len(toxic)
    assert len(set(kept) - toxic) >= 0.99 * (len(rows) - len(toxic))
    unique, docs, _ = step(corpus_pipeline.near_duplicates, docs)
    assert set(unique) == {k for k in kept if copies.get(k) not in kept}
    clean, docs, _ = step(corpus_pipeline.mask_secrets, docs)
    secret = re.compile(r'api_key = "[A-Za-z0-9]+')
    assert set(clean) == set(unique) and all(clean[k]["text"] == secret.sub("[secret]", unique[k]["text"]) for k in clean)
    mixed, docs, _ = step(corpus_pipeline.mix_sources, docs)
    assert 0.5 * len(clean) < len(mixed) < len(clean) and all(mixed[k] == clean[k] for k in mixed)
    pieces = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(mixed)
    for k in mixed:
        own = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == k)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
