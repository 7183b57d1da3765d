"""What the character models of op1 take for random: rates on strings that they were not trained on."""

import glob
import os
import random
import re
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import secret_scan

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")

PLAIN = [
    "-" * 30, "=" * 30, "_" * 25, "0" * 23, "z" * 30, "/usr/local/lib/python/site-packages",
    "this-is-a-long-url-slug-for-page", "AbstractSingletonProxyFactoryBean", "x86_64-unknown-linux-gnu-1_2_3",
    "a/b/c/d/e/f/g/h/i/j/k", "2024-01-02-10-20-30-000", "12345678901234567890", "-+-+-+-+-+-+-+-+-+-+-", "+-----+-----+-----+-----+",
]


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.train(secret_scan.labelled_samples(spark.read.parquet(f"{SF}/documents.parquet")))


def share_found(spark, model, strings):
    docs = spark.createDataFrame(list(enumerate(strings)), "doc_id bigint, text string")
    return secret_scan.scan(docs, model).agg(F.avg((F.size("spans") > 0).cast("double"))).first()[0]


def test_random_strings_are_found(spark, model):
    r = random.Random(3)
    letters, digits = string.ascii_letters, string.digits
    for alphabet in (letters + digits, letters + digits + "+/", letters + digits + "-_", string.ascii_uppercase + digits, string.ascii_lowercase + digits):
        made = ["".join(r.choice(alphabet) for _ in range(r.choice((24, 32, 40)))) for _ in range(200)]
        assert share_found(spark, model, made) >= 0.97, alphabet


def test_identifiers_are_not(spark, model):
    """Names of 20 characters and more in the sources of Python's own library."""
    names = set()
    for path in sorted(glob.glob(f"{os.path.dirname(os.__file__)}/*.py")):
        with open(path, encoding="utf8", errors="replace") as f:
            names.update(re.findall(r"(?<![\w+/-])[A-Za-z_]\w{19,60}(?![\w+/-])", f.read()))
    names = sorted(n for n in names if n.isascii() and len({*n.lower()}) < 20)  # without alphabets in order
    assert len(names) > 500
    assert share_found(spark, model, names) <= 0.02
    assert share_found(spark, model, PLAIN) == 0


def test_pipeline_leaves_ordinary_strings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = "Title\n" + "\n".join(PLAIN) + "\ntoken=abcdef123 end"
    mine = spark.createDataFrame([(-5, text, "en", "x", len(text))], docs.schema)
    got = corpus_pipeline.secrets(spark, docs.unionByName(mine), SF).where("doc_id = -5").first()
    assert got["text"] == text.replace("token=abcdef123", "<secret>") and got["n_chars"] == len(got["text"])


def test_sample_counts_repeated_rows_once(spark):
    copies = spark.range(50_000).select(F.lit(7).alias("doc_id"), F.lit("some words that repeat").alias("text"))
    others = spark.range(300).select(F.col("id").cast("int").alias("doc_id"), F.concat(F.lit("word other "), "id").alias("text"))
    samples = secret_scan.labelled_samples(copies.unionByName(others), sample_docs=100)
    assert samples.where("value = 'repeat'").count() <= 1
    few = secret_scan.labelled_samples(copies, sample_docs=100)
    assert few.where("value = 'repeat'").count() <= 1
    assert secret_scan.labelled_samples(others, sample_docs=100).where("value = 'word'").count() == 100
