import os
import re
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Every stage's rows, by name, each on what the stage before kept."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    out["start"] = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = {r.doc_id: r for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def test_stages_take_the_dealt_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near duplicates", "repeated passages", "benchmark passages", "tokens"]


def test_near_duplicates(stages):
    before, after = stages["toxicity"], stages["near duplicates"]
    sets = {i: shingles(r.text) for i, r in before.items()}
    parent = {i: i for i in sets}
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert set(after) == {i for i in sets if root(i) == i}
    assert all(after[i] == before[i] for i in after)


def test_repeated_passages(stages):
    before, after = stages["near duplicates"], stages["repeated passages"]
    first = {}
    for i in sorted(before):
        raw = before[i].text.encode()
        for k in range(len(raw) - corpus_pipeline.PASSAGE_BYTES + 1):
            first.setdefault(raw[k:k + corpus_pipeline.PASSAGE_BYTES], i)
    for i, row in before.items():
        raw = row.text.encode()
        repeated = any(first[raw[k:k + 160]] < i for k in range(len(raw) - 159))
        if not repeated:
            assert after[i] == row
        elif i in after:
            assert len(after[i].text) < len(row.text) and after[i].n_chars == len(after[i].text)
            assert "�" not in after[i].text


def test_tokens(stages):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert set(stages["tokens"]) == set(stages["benchmark passages"])
    for i, row in stages["tokens"].items():
        text = stages["benchmark passages"][i].text
        assert row.text == text
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_only_some_go(stages):
    assert 0.7 * len(stages["start"]) < len(stages["tokens"]) <= len(stages["start"])


def test_odd_rows(spark, documents, odd_rows, folder):
    docs = documents(odd_rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    assert {r.doc_id for r in docs.collect()} >= {None, 1, 2, 3, 4, 6, 8, 10}


def test_the_rest_works_without_this_subpackage(tmp_path):
    """The other queries import when the subpackage and the pipeline are gone, and nothing else needs them."""
    import shutil

    for name in ("__spark_entry__.py", "huntframe"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_every_operator_is_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 14 and {n.split("_")[0] for n in names} == {"pipeline", *[f"op{i}" for i in range(1, 14)]}


def test_one_id_with_several_texts(spark, documents):
    def prose(start, n=40):
        return " ".join(f"w{k}" for k in range(start, start + n))

    rows = [(1, prose(0)), (2, prose(0) + " end"), (2, prose(500)), (3, prose(900)), (3, prose(900)), (3, prose(900) + " end"), (4, prose(500) + " end"),
            (5, None), (5, ""), (None, prose(0)), (None, prose(0))]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(rows), "").collect()
    by_id = sorted((r.doc_id or 0, r.text or "") for r in kept)
    assert [i for i, _ in by_id] == [0, 0, 1, 2, 3, 5, 5]
    assert (1, prose(0)) in by_id and (2, prose(500)) in by_id
    assert corpus_pipeline.drop_near_duplicates(spark, documents([]), "").count() == 0


def test_rows_of_one_id_and_text_leave_a_fixed_one(spark):
    rows = [(1, "same words here", lang, source, 15) for lang, source in (("fr", "b"), ("de", "c"), ("de", "a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 3):
        kept = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), "").collect()
        assert [(r.lang, r.source) for r in kept] == [("de", "a")]
