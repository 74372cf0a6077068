"""Proper names: each rule by a sentence of its own, and the evidence of a batch."""

import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.operators import names

# A sentence, names that it must give, and names that it must not give.
CASES = [
    ("Last week Orbital released Nimbus Cloud 7 for testers.", "orbital|nimbus cloud 7", "nimbus|cloud|nimbus cloud"),
    ("They measured LLX-4.1 and TCP/IP over HTTP/3.", "llx 4.1|tcp ip|http 3", "llx|http|tcp"),
    ("Prices rose slowly. Vendors wait for news.", "", "prices|vendors"),
    ("News of the deal spread. Update lands on Friday, I hear.", "", "news|update|friday|i"),
    ("Falcon flew twice. Everyone waited for Falcon again.", "falcon", "everyone"),
    ("We saw Brill Corp, Dynex, Quill, and Tessera there.", "brill corp|dynex|quill|tessera", "brill corp dynex"),
    ("People read One Two Three Four Five Six aloud.", "one two three four|five six", ""),
    ("우리는 Nimbus Cloud 7를 써 봤다.", "nimbus cloud 7", ""),
    ("어제 Orbital과 만났다.", "orbital", ""),
    ("We had iPod, watchOS and eBook on a 4chan or 500px page, in 3.js or with 9M.", "ipod|watchos|ebook|4chan|500px|3js|9m", "m|px|js"),
    ("The archive is 7-Zip here, in the 3rd folder of the 21st disk.", "7 zip", "zip|3rd|21st"),
    ("They met Anna B. Carver, J. R. Dunn and H. George Pell there.", "anna b carver|j r dunn|h george pell", "carver|dunn|anna b"),
    ("We chose plan B. Buyers pay later.", "", "buyers|plan b buyers"),
    ("They asked Dr. Ames and Prof. Birch at St. Helens near Mt. Hood.", "ames|birch|st helens|mt hood", "dr|prof|dr ames|helens"),
    ("He served in the U.S. Navy at 9 a.m. Monday.", "us navy", "us|navy"),
    ("The work ran in C++/CX, with C++, C#, F#/.NET and .NET too.", "c++ cx|c++|c#|f# .net|.net", "c|cx|f#|net"),
    ("He wrote Ｃ＋＋, ＡＢＣ－７．１, ．ＮＥＴ, Ｖｕｅ．ｊｓ and ５．ｊｓ by hand.", "c++|abc 7.1|.net|vue js|5js", "c|abc|net|vue"),
    ("背景です．Buyers pay. 引用！Users wait. 次。Vendors ask. ４．Payers come.", "", "buyers|users|vendors|payers"),
    ("The tool WALL·E met GPX‑5 and GPX–6.", "wall e|gpx 5|gpx 6", "wall|e"),
    ("They praised Lumen—Vertex liked it too.", "lumen|vertex", "lumen vertex"),
    ("She joined the Bank of Iceland and cited Juan de la Vega, Otto van der Berg and House of the Sun.", "bank of iceland|juan de la vega|otto van der berg|house of the sun", "bank|iceland|vega"),
    ("They hired Brill Corp of the year and Dynex de la mode.", "brill corp|dynex", "brill corp of|dynex de la"),
    ("We met Marks & Sons, B&O and R&D Global.", "marks sons|b o|r d global", "marks|sons|o"),
    ("They sued Brill, Inc. and Kor Co., Ltd. and Vex, S.A. and Nim,LLC in court with Tom Hill, Jr. there.", "brill inc|kor co ltd|vex sa|nim llc|tom hill jr", "inc|ltd|brill|vex"),
    ("It hit Dynex 2024 targets, Dynex 30 percent gains, Brill 400 employees and GTX 3080 cards.", "dynex|brill|gtx 3080", "dynex 2024|dynex 30|brill 400"),
    ("We tried Orbital's Nimbus and Land's own shop.", "orbital|nimbus|lands", "orbital nimbus|orbitals|orbitals nimbus|land"),
    ('She said, "Buyers pay later." He said “Users wait.” and ‘ Vendors ask now’ too.', "", "buyers|users|vendors"),
    ('We called "Orbital" and “Nimbus” and «Lumen» fine, with "Vertex" too.', "orbital|nimbus|lumen|vertex", ""),
    ('They said "hello" Orbital first.', "orbital", ""),
    ("They said, 'We're closing now.'", "", "were"),
    ("They said, 'Buyers' demand falls.'", "", "buyers"),
    ("We liked 'Orbital' and James' Nimbus then.", "orbital", ""),
    ("They saw (Buyers pay later.) and [Users wait now.] but Brill Corp (Dynex) and Kor Corp [Vex] stay.", "brill corp|dynex|kor corp|vex", "buyers|users"),
    ("The note says: Buyers pay later.", "", "buyers"),
    ("The study found — Users prefer less.", "", "users"),
    ("The finalists are: Orbital, Nimbus and Lumen.", "orbital|nimbus|lumen", ""),
    ("They named the winner: Orbital.", "orbital", ""),
    ("Fees rose… Buyers pay. “Vendors ask.” Users wait.", "", "buyers|vendors|users"),
    ("A heading\nBuyers pay later", "", "buyers|a heading buyers"),
    ("It slipped...Then nobody came.", "", ".then|slipped"),
    ('He likes ".NET" and (.NET) and .NET more.', ".net", "net"),
    *((f"{mark} Buyers pay later.", "", "buyers") for mark in ("1)", "[1]", "(a)", "(ii)", "1:", "1 -", "2.1)", "-", '"', "•", "A)")),
    ("X: Zed 5 ships today.\nThey think X works.", "x|zed 5", ""),
    ("They cited Noël Øster and Nguyễn Văn Bảo today.", "noël øster|nguyễn văn bảo", "no|nguy|noe"),
    (unicodedata.normalize("NFD", "They cited Noël Øster today."), "noël øster", "noe"),
    ("   ", "", ""), ("... --- ...", "", ""), ("한글만 있다.", "", ""), ("", "", ""), (None, "", ""),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, *_) in enumerate(CASES)], "doc_id long, text string").withColumn("own", F.col("doc_id"))
    got: dict = {i: {} for i in range(len(CASES))}
    for r in names.extract_names(rows.repartition(3), batch="own").collect():
        assert r.batch == r.doc_id and r.name not in got[r.doc_id]
        got[r.doc_id][r.name] = r.surface
    return got


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    text, wanted, unwanted = CASES[i]
    missing = {n for n in wanted.split("|") if n and n not in found[i]}
    wrong = {n for n in unwanted.split("|") if n and n in found[i]}
    assert not missing and not wrong, (text, found[i])
    assert all(s in unicodedata.normalize("NFC", text) or s in text for s in found[i].values())


def names_of(spark, texts, **how):
    out = [{} for _ in texts]
    for r in names.extract_names(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **how).collect():
        out[r.doc_id][r.name] = r.surface
    return out


def test_possessives_of_a_batch(spark):
    """Folded where the batch has the name without it, and the surface with it; kept where not."""
    texts = ["We saw Orbital's new plan.", "They say Orbital grows.", "We saw Brink's own plan.", "They cite Brink's older plan."]
    got = names_of(spark, texts)
    assert got[0] == {"orbital": "Orbital"} and got[1] == {"orbital": "Orbital"}
    assert got[2] == {"brinks": "Brink's"} and got[3] == {"brinks": "Brink's"}


def test_first_surface(spark):
    assert names_of(spark, ["They like NIM-5 and Nim 5."])[0] == {"nim 5": "NIM-5"}
    # The surface that opens the sentence counts only where the name is one.
    assert names_of(spark, ["Orbital grows. We like ORBITAL."])[0] == {"orbital": "Orbital"}


def test_share_of_documents(spark):
    texts = [f"They met Brill Corp in room {i}." for i in range(4)] + ["They met nobody."]
    assert all("brill corp" not in x for x in names_of(spark, texts))
    assert names_of(spark, texts, least_batch=6)[0] == {"brill corp": "Brill Corp"}
    assert names_of(spark, [*texts, "no", "no", "no"])[0] == {"brill corp": "Brill Corp"}
    assert names_of(spark, texts, ratio=1.0, least_docs=5) == [{}] * 5


def test_batches_are_apart(spark):
    """Evidence in one batch says nothing in another."""
    rows = [(1, "Falcon flew.", "a"), (2, "We like Falcon.", "a"), (3, "Falcon flew.", "b"), (4, "Falcon flew.", None), (4, "We like Falcon.", None)]
    got = names.extract_names(spark.createDataFrame(rows, "doc_id long, text string, day string"), batch="day").collect()
    assert {(r.batch, r.doc_id) for r in got} == {("a", 1), ("a", 2), (None, 4)}


def test_width(spark):
    assert names_of(spark, ["They ran Nimbus Cloud 7 today."], longest=2)[0] == {"nimbus cloud": "Nimbus Cloud"}


def test_long_texts(spark):
    """Runs, tokens and sentences of any length end in time, and lose no name."""
    texts = ["x " + "Name " * 20_000, "y " + "A" * 50_000, "z " + "Ab-" * 20_000, "say " + "a.b" * 20_000, '"(“' * 20_000, "1." * 20_000, "The " + ", ".join(f"N{i}a" for i in range(5000))]
    got = names_of(spark, texts)
    assert got[0] == {"name name name name": "Name Name Name Name"} and len(got[6]) == 5000
    assert list(got[1]) == ["a" * 50_000]


def test_plan(spark, sf):
    """Candidates are found in the scan's stage: no shuffle and one Python node, for the names' keys."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = names.candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange " not in plan and plan.count("ArrowEvalPython") == 1


def test_sentence_ends_look_once(spark):
    """Blanks before a line's end begin no match of their own, and change no name."""
    assert spark.sql("SELECT 1").select(F.regexp_replace(F.lit("a  \n b"), names.SENTENCE_END, "|").alias("t")).first().t == "a  |b"
    docs = spark.createDataFrame([(1, "We met Ada Lovelace   \n \n near Bath \t\n  Then Charles Babbage came."), (2, "We met Ada Lovelace\nnear Bath\nThen Charles Babbage came.")], "doc_id long, text string")
    found = [sorted(r.name for r in names.extract_names(docs.where(f"doc_id = {i}")).collect()) for i in (1, 2)]
    assert found[0] == found[1] and "ada lovelace" in found[0]


def test_names_are_folded_once_a_batch(monkeypatch):
    asked = []
    monkeypatch.setattr(X, "canonical", lambda n: asked.append(n) or (n and n.lower()))
    assert list(X.canonical_name.func(pd.Series(["A b", None, "A b", "C"], dtype=object))) == ["a b", None, "a b", "c"]
    assert asked.count("A b") == 1
