"""One very long text beside short ones, in the operators that scan texts: nothing is cut, and results are those of a plain reading."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from codeloom.llm import decontam, licenses, quality, secrets, simhash


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(12)
    words = [f"Word{i}" for i in range(5000)] + ["é", "straße", "#", "x|y"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".\n"]) for _ in range(300_000))


def one(spark, text, **columns):
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([(7, text, *columns.values()), (8, "short", *columns.values())], "doc_id long, text string" + (", " + schema if schema else ""))


def test_fingerprint(spark, long_text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), long_text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    got = {r.doc_id: r for r in simhash.simhash_groups(one(spark, long_text)).collect()}
    assert got[7].fingerprint == f"{want:016x}" and got[7].component_id == 7


def test_leak_at_the_end(spark, long_text):
    item = "a passage of the benchmark that nobody should have seen before the test was taken"
    text = long_text + " " + item.replace("nobody", "nobudy")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (hit,) = decontam.find_leaks(one(spark, text), bench).collect()
    n = len(decontam.normal(text))
    assert (hit.doc_id, hit.item_id, hit.edits, hit.end) == (7, 1, 1, n) and hit.start == n - len(item)
    assert [r.doc_id for r in decontam.drop_leaks(one(spark, text), bench).collect()] == [8]


def test_license_digest(spark, long_text):
    got = {r.doc_id: r for r in licenses.scan_licenses(one(spark, long_text + "\nReleased under the MIT License.")).collect()}
    low = re.sub(licenses.PUNCTUATION, " ", (long_text + "\nReleased under the MIT License.").lower()).strip()
    assert got[7].canonical_sha256 == hashlib.sha256(low.encode()).hexdigest() and got[7].license is None and got[7].notices == "MIT:notice"


def test_quality_figures(spark, long_text):
    words = re.findall(r"[^\x20\x09-\x0D]+", long_text)
    grams: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    row = next(r for r in quality.measure(one(spark, long_text, lang="en")).collect() if r.doc_id == 7)
    assert (row.n_words, row.word_chars, row.n_repeat_words) == (len(words), sum(map(len, words)), len(repeated))


def test_secret_at_the_end(spark, long_text):
    value = "ghp_" + "aB3" * 10
    text = f"{long_text} é password = hunter2hunter2 {value}"
    row = next(r for r in secrets.scan_secrets(one(spark, text, source="s")).collect() if r.doc_id == 7)
    a, b = text.index("password ="), text.index(value)
    assert row.spans == f"assign:{a}:{a + 25},github:{b}:{b + len(value)}"
