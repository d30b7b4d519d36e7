import random
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as C
from askbook.llm import packing as P
from askbook.llm import pii
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, d = random.Random(6), str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(r.choices(["ta", "ri", "mo", "en", "ul", "ske"], k=r.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        toxic = r.random() < 0.25
        lines = [" ".join(word() for _ in range(r.randint(3, 60))) for _ in range(r.randint(1, 4))]
        if toxic:
            lines[0] += " vile odious vile grubby odious grubby"
        if i % 9 == 0:
            lines.insert(1, "This boilerplate line occurs in many of the documents here")
        if i % 11 == 0:
            lines.append(f"mail q{i}@x.org or +1 (357) 555-{i:04d}")
        rows.append((i, "\n".join(lines), "en", "s", 5))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s", 5) for i in range(0, 60, 3)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "long " * 30000, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in C.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        done = stage(spark, docs, sf_dir)
        if name == "packing":
            encode, _ = P.load(C.tokenizer("byte_bpe_50k.json"))
            own = defaultdict(list)
            for r in done.collect():
                own[r.doc_id].append(r)
            assert set(own) == {i for i, _ in before}
            for i, t in before:
                ids = b"".join(bytes(r.ids) for r in sorted(own[i], key=lambda r: r.start))
                assert ids == np.append(encode(t or ""), 0).astype("<u4").tobytes()
            assert sorted(map(tuple, C.run(spark, sf_dir).groupBy("doc_id").agg({"length": "sum"}).collect())) == sorted((i, sum(r.length for r in rs)) for i, rs in own.items())
            break
        assert done.columns == columns
        out = f"{sf_dir}/{name}"
        done.write.parquet(out)
        docs = spark.read.parquet(out)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.where("text IS NOT NULL").collect()) or name in ("toxicity", "simhash")
        if name == "toxicity":
            want = {i for i, t in before if "vile" not in (t or "")}
            assert set(after) == want
            assert all(not labels.get(i) for i in after)
        elif name == "line_dedup":
            assert after == {d: t for d, _, _, t in plain_lines(before)}
            assert sum("boilerplate" in t for t in after.values()) == 1
        elif name == "simhash":
            component = plain_components([(i, plain_fingerprint(t)) for i, t in before])
            assert set(after) == {i for i, c in component.items() if i == c}
        elif name == "pii":
            s = pii.Surrogates(C.PII_KEY)
            assert after == {i: pii.replace(t, s)[0] if t else t for i, t in before}
            assert not any("@x.org" in (t or "") and f"q{i}@x.org" in t for i, t in after.items())


def test_rows_that_share_an_id_are_told_apart(spark):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60))
    a, b, c, d, e = text(), text(), text(), text(), text()
    rows = [(1, a), (5, a), (5, b), (5, c), (5, c), (7, b), (None, a), (None, d), (None, d), (None, e), (None, None), (None, "")]  # the first row of 5 copies 1, its others are the least of their groups
    done = C.one_of_each(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "")
    assert done.columns == ["doc_id", "text"]
    assert sorted(map(tuple, done.where("doc_id IS NOT NULL").collect())) == sorted([(1, a), (5, b), (5, c)])
    assert sorted((r.text or "" for r in done.where("doc_id IS NULL").collect())) == sorted(["", d, e])


def test_columns_with_clashing_names_and_a_key_of_ones_own(spark):
    rows = [(1, "Mr Smith wrote q@x.org", 1, "x"), (2, "Mr Smith wrote q@x.org", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, stay_id string")
    assert [tuple(r)[0] for r in C.one_of_each(spark, docs, "").collect()] == [1]
    none = spark.createDataFrame([(3, None), (3, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in C.one_of_each(spark, none, "").collect()] == [(3, None)]
    public = C.replace_personal(spark, docs, "").first().text
    spark.conf.set("spark.askbook.piiKey", "secret")
    try:
        assert C.replace_personal(spark, docs, "").first().text not in (public, rows[0][1])
    finally:
        spark.conf.unset("spark.askbook.piiKey")
