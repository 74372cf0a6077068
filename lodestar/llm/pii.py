"""Personal data by candidate gradient boosting; DataFrame operations only.

Generators of high recall propose spans that may overlap: everything that looks like an address with ``@``, four groups of
digits, a long number, or a telephone number. Spans that pass the strict rules of a kind (email, ip, card, phone) are
redacted as they stand. All other candidates are judged by boosted trees over their format and context (digits, marks,
letters before and behind, check sums, words such as "call" or "card" in front), and the ones over a threshold that is calibrated per
generator on held-out candidates are added, unless they overlap a span already taken.

The trees learn what the strict rules can't see: strict spans serve as positives in forms that the rules don't take (``VARIANTS``: an
address without ``@``, a telephone number without plus and country code, a card with dots), in the context of the strict span and for each generator that would
propose the form whole. Negatives are the candidates that the trees would judge, those that overlap no strict span, apart from
ones whose context or form speaks for personal data (``_unsure``): these have no label. Addresses whose host lost its
domain, order numbers of a telephone number's digits and cards a digit short are negatives too. Half of all rows by hash fit the trees, of these ``sample_rows`` of least hash; the other half, all of it, sets each
generator's threshold: the least score at which precision reaches ``precision`` with ``least_rows`` rows or more. A generator for
which no score does, or that has fewer than ``least_rows`` held-out negatives, adds nothing. The trees are then written out as one Column expression, so scoring is a
projection without a shuffle, and no text leaves its row.

Null text counts as empty; texts without candidates have no spans. With nothing to learn from (an empty table, one class
alone) only strict spans are found. Rows are judged one by one, so repeated rows get equal results. Offsets are code points, ends
exclusive. Columns other than doc_id and text are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import documents, stored

WORK = "_lodestar_pii"
KINDS = ["email", "ip", "card", "phone"]
# The look-behind starts a match at the head of a run of its characters, or where the last match ended: what
# scanning each place would find, without scanning a run again from each of its characters. Possessive
# quantifiers give up nothing here and keep long runs off the stack.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match; finding it is cheap.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    "address": r"(?<![^\s@<>(),;:\[\]])[^\s@<>(),;:\[\]]++ ?(?:@|\(at\)|\[at\]) ?[^\s@<>(),;:\[\]]++",
    "dotted": r"[0-9]++(?:[.:][0-9]++){3,}+",
    "number": r"[0-9](?:[ .-]{0,2}[0-9]){8,}+",
    "dialled": r"\+?\(?[0-9]{1,4}+\)?(?:[ ./-]?\(?[0-9]{2,}+\)?){2,}+",
}
LOOSE_NEEDS = {"address": r"@|[(\[]at[)\]]", "dotted": r"[0-9][.:][0-9]", "number": r"[0-9][ .-]{0,2}[0-9]", "dialled": r"[0-9]{2}"}
WORDS_BEFORE = r"(?i)\b(tel|telefon|phone|call|fax|mobile|card|visa|iban|mail|e-mail|ip|address|contact|number|nr|no)\b"


@dataclass(frozen=True)
class PiiRules:
    """See the module; rounds and depth are those of the boosting."""

    sample_rows: int = 20_000
    precision: float = 0.98
    least_rows: int = 20
    rounds: int = 8
    depth: int = 3
    context: int = 24


# ---------------------------------------------------------------- spans


def _matches(df: DataFrame, text: str, pattern: str, needs: str, out: str) -> DataFrame:
    """df with out: array<struct<start int, end int, span string>> of the matches of pattern, from the left.

    A regular expression's matches and the parts between them come from the same scan order, so a match starts
    behind all parts and matches before it.
    """
    parts, found = f"{out}_parts", f"{out}_found"
    with_needed = F.col(text).contains(needs) if needs == "@" else F.col(text).rlike(needs)
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(with_needed, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none))
    # Lengths alone are kept: of a part, and of the match behind it.
    between = F.when(F.size(found) > 0, F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(parts, between)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,span:string>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["span"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["span"].alias("span")))).alias("spans"))

    pairs = F.zip_with(F.slice(F.col(parts), 1, F.greatest(F.size(found), F.lit(1))), F.col(found), lambda g, m: F.struct(F.coalesce(g, F.lit(0)).alias("gap"), m.alias("span")))
    spans = F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(start["spans"])
    return df.withColumn(out, spans).drop(parts, found)


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn_rest(number: Column) -> Column:
    """The Luhn sum of a string of digits modulo 10."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 1, F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), d.try_cast("int"))).otherwise(d.try_cast("int")))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10


def octets_fit(span: Column) -> Column:
    """Whether all dotted numbers are at most 255, whatever zeros stand in front."""
    return F.forall(F.split(span, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))


def _holding(kind: str):
    """Whether a match of the kind's pattern is one of it."""

    def holds(s: Column) -> Column:
        if kind == "ip":
            return octets_fit(s["span"])
        n = F.length(digits(s["span"]))
        return n.between(9, 15) if kind == "phone" else n.between(13, 19) & (luhn_rest(digits(s["span"])) == 0)

    return holds


def with_strict_spans(df: DataFrame, text: str) -> DataFrame:
    """df with WORK_email, WORK_ip, WORK_card and WORK_phone: the strict spans of each kind."""
    for kind in KINDS:
        column = f"{WORK}_{kind}"
        df = _matches(df, text, STRICT[kind], NEEDS[kind], column)
        if kind != "email":
            df = df.withColumn(column, F.filter(column, _holding(kind)))
    return df


def strict_array(kinds: list[str] = KINDS) -> Column:
    """All strict spans, by kind and start."""

    def of(i: int):
        return lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    return F.concat(*[F.transform(f"{WORK}_{k}", of(i)) for i, k in enumerate(kinds)])


FEATURES = ["n_chars", "n_digits", "n_marks", "n_letters", "n_at", "n_dots", "n_spaces", "plus", "bracket", "luhn", "octets", "before_word", "before_letter", "behind_letter", "domain", "generator"]
DOMAIN = r"(?:@|[(\[]at[)\]]) ?[^\s@]+\.\p{L}{2,}$"
#: Kind, pattern in a strict span and what stands for it in a form that the strict rules don't take, and the label of that form.
VARIANTS = [
    ("email", "@", " (at) ", 1.0),
    ("email", "@", "[at]", 1.0),
    ("email", "@([A-Za-z0-9-]+).*", " (at) $1", 0.0),
    ("email", "@([A-Za-z0-9-]+).*", "@$1", 0.0),
    # As many dots with a domain as without one, so that their number doesn't stand for it.
    ("email", r"^(?:.*[^A-Za-z0-9])?([A-Za-z0-9]+)@.*?([A-Za-z0-9-]+\.[A-Za-z]{2,})$", "$1 (at) $2", 1.0),
    ("email", r"^(?:.*[^A-Za-z0-9])?([A-Za-z0-9]+)@([A-Za-z0-9-]+).*", "$1 (at) $2", 0.0),
    # Two short words, as in any sentence.
    ("email", r"^[^A-Za-z]*([A-Za-z]{1,5}).*@([A-Za-z]{1,4}).*", "$1 (at) $2", 0.0),
    ("phone", r"^\+[0-9]{1,3}[ .-]+(?=\()", "", 1.0),
    ("phone", r"^\+[0-9]{1,3}[ .-]+(?=[1-9])", "0", 1.0),
    ("phone", r"^\+[0-9]{1,3}[ .-]*\(0?([0-9]+)\)", "0$1", 1.0),
    ("card", "[ -]", ".", 1.0),
    # What only looks like them: an order number of the same digits, a number that is a digit short and fails the check sum.
    ("phone", r"^\+[0-9]{1,3}[ .-]*\(?0?([0-9]{2,4})\)?[ .-]*([0-9]{2,4})[ .-]*([0-9]{2})([0-9]{2})$", "$1$2-$3-$4", 0.0),
    ("card", "[0-9]$", "", 0.0),
]


def _features(s: Column, text: Column, loose: int, rules: PiiRules) -> Column:
    span = s["span"]
    before = F.substring(text, F.greatest(s["start"] - rules.context + 1, F.lit(1)), F.least(s["start"], F.lit(rules.context)))
    behind = F.substring(text, s["end"] + 1, F.lit(2))
    n = F.char_length(span)

    def count(what: str) -> Column:
        return (n - F.char_length(F.regexp_replace(span, what, ""))).cast("double")

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    values = [
        n.cast("double"), count("[0-9]"), count(r"[^\p{L}0-9\s]"), count(r"\p{L}"), count("@"), count(r"\."), count(r"\s"), flag(span.startswith("+")), flag(span.contains("(")),
        luhn_rest(digits(span)).cast("double"), flag(octets_fit(span)), flag(before.rlike(WORDS_BEFORE)), flag(before.rlike(r"\p{L}$")), flag(behind.rlike(r"^\p{L}")), flag(span.rlike(DOMAIN)), F.lit(float(loose)),
    ]
    return F.array(*values)


def with_candidates(df: DataFrame, text: str, rules: PiiRules, unsure: bool = False) -> DataFrame:
    """df with WORK_candidates: array<struct<loose, start, end, features>> of all generators; with unsure, that flag too."""
    for name in LOOSE:
        df = _matches(df, text, LOOSE[name], LOOSE_NEEDS[name], f"{WORK}_{name}")

    def of(i: int):
        return lambda s: F.struct(F.lit(i).alias("loose"), s["start"].alias("start"), s["end"].alias("end"), _features(s, F.col(text), i, rules).alias("features"), *([_unsure(s, F.col(text), rules).alias("unsure")] if unsure else []))

    every = F.concat(*[F.transform(f"{WORK}_{name}", of(i)) for i, name in enumerate(LOOSE)])
    return df.withColumn(f"{WORK}_candidates", every).drop(*[f"{WORK}_{name}" for name in LOOSE])


# ---------------------------------------------------------------- trees


def _tree(node, x: Column) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(int(split.featureIndex()))) <= F.lit(float(split.threshold())), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


@dataclass(frozen=True)
class Judge:
    """Trees and the threshold of each generator (None: it adds nothing)."""

    trees: tuple = ()
    weights: tuple = ()
    thresholds: tuple = ()

    def score(self, x: Column) -> Column:
        """Margin of the boosted trees."""
        return sum((F.lit(float(w)) * _tree(t.rootNode(), x) for w, t in zip(self.weights, self.trees)), F.lit(0.0))

    def accepts(self, c: Column) -> Column:
        out = F.lit(False)
        for i, least in enumerate(self.thresholds):
            if least is not None:
                out = out | ((c["loose"] == i) & (self.score(c["features"]) >= F.lit(float(least))))
        return out


def _unsure(s: Column, text: Column, rules: PiiRules) -> Column:
    """Whether a candidate outside the strict rules may be personal data by form or context."""
    before = F.substring(text, F.greatest(s["start"] - rules.context + 1, F.lit(1)), F.least(s["start"], F.lit(rules.context)))
    n = F.length(digits(s["span"]))
    return s["span"].rlike(DOMAIN) | (before.rlike(WORDS_BEFORE) & n.between(7, 19)) | (n.between(13, 19) & (luhn_rest(digits(s["span"])) == 0))


def _variant_rows(text: Column, rules: PiiRules) -> Column:
    """array<struct<loose, start, end, label, features>> of the strict spans in other forms, by generator that takes the form whole."""
    found = []
    for kind, pattern, instead, label in VARIANTS:
        for i, (name, loose) in enumerate(LOOSE.items()):
            if (kind == "email") == (name == "address"):
                forms = F.transform(f"{WORK}_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["span"].alias("old"), F.regexp_replace(s["span"], pattern, instead).alias("span")))
                forms = F.filter(forms, lambda s: (s["span"] != s["old"]) & s["span"].rlike(f"^(?:{loose})$"))
                if kind == "card" and not label:
                    forms = F.filter(forms, lambda s: luhn_rest(digits(s["span"])) != 0)
                found.append(F.transform(forms, lambda s: F.struct(F.lit(i).alias("loose"), s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label"), _features(s, text, i, rules).alias("features"))))
    return F.concat(*found)


def train(docs: DataFrame, rules: PiiRules) -> Judge:
    """Fits the trees on a bounded sample of docs' rows, and their thresholds on all that are held out."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike("[0-9@]|[(\\[]at[)\\]]"))
    df = with_strict_spans(df, "text").withColumn(f"{WORK}_strict", strict_array()).withColumn(f"{WORK}_variants", _variant_rows(F.col("text"), rules))
    df = with_candidates(df, "text", rules, unsure=True)
    free = F.filter(f"{WORK}_candidates", lambda c: ~c["unsure"] & ~F.exists(f"{WORK}_strict", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    negatives = F.transform(free, lambda c: F.struct(c["loose"].alias("loose"), c["start"].alias("start"), c["end"].alias("end"), F.lit(0.0).alias("label"), c["features"].alias("features")))
    rows = df.select("doc_id", F.explode(F.concat(f"{WORK}_variants", negatives)).alias("c")).select("c.loose", "c.features", "c.label", F.xxhash64("doc_id", "c.start", "c.end").alias("h"))
    # By place, so that the forms of one span are all fitted or all held out. Equal candidates of copies have different hashes by doc_id; the least hashes are a fair sample of all.
    fits = F.pmod("h", F.lit(2)) == 0
    sample = stored(rows.where(fits).orderBy("h").limit(rules.sample_rows).select("loose", "label", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)]), "pii-sample")
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return Judge()
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x")
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=rules.rounds, maxDepth=rules.depth, seed=7).fit(vectors.transform(sample))
    java = model._java_obj
    judge = Judge(tuple(java.trees()), tuple(java.treeWeights()))
    scored = rows.where(~fits).select("loose", "label", judge.score(F.col("features")).alias("score"))
    # A row per generator and leaf combination at most.
    by_score: dict[int, list] = {}
    for r in scored.groupBy("loose", "score").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).collect():
        by_score.setdefault(r.loose, []).append((r.score, r.n, r.hits))
    thresholds = []
    for i in range(len(LOOSE)):
        n = hits = 0
        least = None
        for score, k, good in sorted(by_score.get(i, []), reverse=True):
            n, hits = n + k, hits + good
            if n >= rules.least_rows and hits >= rules.precision * n:
                least = score
        thresholds.append(least if n - hits >= rules.least_rows else None)
    return Judge(judge.trees, judge.weights, tuple(thresholds))


# ---------------------------------------------------------------- results


def with_spans(docs: DataFrame, rules: PiiRules = PiiRules(), judge: Judge | None = None) -> DataFrame:
    """docs with WORK_spans, all spans by start, and the strict spans by kind. struct<kind, start, end>: kind is a place in
    KINDS, or len(KINDS) for spans that the trees add."""
    judge = judge or train(docs, rules)
    df = docs.withColumn(f"{WORK}_text", F.coalesce("text", F.lit("")))
    df = with_strict_spans(df, f"{WORK}_text").withColumn(f"{WORK}_strict", strict_array())
    if any(t is not None for t in judge.thresholds):
        df = with_candidates(df, f"{WORK}_text", rules)
        free = F.filter(f"{WORK}_candidates", lambda c: ~F.exists(f"{WORK}_strict", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
        df = df.withColumn(f"{WORK}_free", free)
        good = F.transform(F.filter(f"{WORK}_free", judge.accepts), lambda c: F.struct(F.lit(len(KINDS)).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        df = df.withColumn(f"{WORK}_good", good)
        # Overlapping additions become one span.
        none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
        last = lambda acc: F.get(acc, F.size(acc) - 1)
        merged = F.aggregate(
            F.array_sort(F.transform(f"{WORK}_good", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))), none,
            lambda acc, c: F.when(
                (F.size(acc) > 0) & (last(acc)["end"] > c["start"]),
                F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.lit(len(KINDS)).alias("kind"), last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], c["end"]).alias("end")))),
            ).otherwise(F.concat(acc, F.array(F.struct(F.lit(len(KINDS)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))),
        )
        df = df.withColumn(f"{WORK}_added", merged).drop(f"{WORK}_good", f"{WORK}_free", f"{WORK}_candidates")
    else:
        df = df.withColumn(f"{WORK}_added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    return df.withColumn(f"{WORK}_spans", F.concat(f"{WORK}_strict", f"{WORK}_added"))


def as_text(spans: Column) -> Column:
    names = F.lit([*KINDS, "boosted"])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def pii(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """Per row of docs: doc_id, the counts by kind, n_boosted, n_spans (all together), base_sha256 and spans."""
    df = with_spans(docs.select("doc_id", "text"), rules)
    return df.select(
        "doc_id",
        *[F.size(f"{WORK}_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.size(f"{WORK}_added").cast("long").alias("n_boosted"),
        F.size(f"{WORK}_spans").cast("long").alias("n_spans"),
        F.sha2(as_text(F.col(f"{WORK}_strict")), 256).alias("base_sha256"),
        as_text(F.col(f"{WORK}_spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets; overlapping spans are replaced together,
    under the kind of the first. Null text stays null."""
    df = with_spans(docs, rules)
    names = F.lit([f"<{k.upper()}>" for k in KINDS] + ["<PII>"])
    ordered = F.array_sort(F.transform(f"{WORK}_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    df = df.withColumn(f"{WORK}_ordered", ordered)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(f"{WORK}_text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], -s["back"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(f"{WORK}_ordered", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    clean = F.when(F.size(f"{WORK}_ordered") > 0, done).otherwise(F.col("text"))
    return df.withColumn(f"{WORK}_clean", clean).select(*[F.col(f"{WORK}_clean").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with production parameters."""
    return pii(documents(spark, sf_dir))


QUERIES = {"op10_pii": op10_pii}
