r"""Proper names in texts: candidates by patterns inside the JVM, evidence by grouping over a batch.

A text is marked where a dot doesn't end a sentence (initials, titles), cut into sentences, and each sentence is searched with one pattern: a run of
tokens that open a name, with version numbers, joining words, ampersands, initials' dots and company endings in between. What stands in front of a run
says whether it opens its sentence or a clause in it. All that is an expression over columns, so a text is read once, without a shuffle and without
Python; only the key of a name (Unicode folding) is a pandas UDF over the candidates.

Over a batch, a possessive is folded into the name without it where that occurs; a single word that opens sentences only is no name; and a name in more
than a share of the batch's documents tells nothing. These are counts by name, so a frequent name is pre-aggregated before the shuffle.

Scripts without upper case have no candidates; their letters stand between names as what they are. Null and empty texts have none. Rows with equal doc_id are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import canonical_name
from lodestar.sources import tables as T
from lodestar.sources.shared import spread, stored

# Words that are no names by themselves.
STOPWORDS = (
    "a an the and but or this that these those available new report today yesterday tomorrow however meanwhile according update news "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december i"
).split()
# Titles and other short forms that a dot follows, and those of them that begin a name.
SHORT_FORMS = "capt col dr gen gov hon jr lt mr mrs ms mt prof rep rev sen sgt sr st".split()
NAME_OPENERS = "st mt".split()
# Words between two parts of a name.
JOINING = "of de del della di da du van von la le the der den des dos das ter".split()
# Endings behind a comma that belong to the name.
ENDINGS = "inc llc llp ltd plc co corp gmbh ag sa bv nv pty oy ab jr sr".split()
# What a number counts.
COUNTED = "percent employees".split()

#: Marks in place of characters: a dot inside a name, a dot behind a title, a letter without case, the start of a sentence.
STAYS, TITLE, UNCASED, BEGIN = "\ue000", "\ue001", "\ue002", "\ue003"

S = r"[\s\p{Z}]"
#: Marks and space. Repeated groups have bounds, and what repeats without is one class, as deep recursion would end a JVM.
FILL = r"[\p{P}\p{S}\s\p{Z}]"
W = r"[a-z\p{L}\p{M}\p{N}]"
CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"
DOT = r"[.．]"
SIGNS = r"[+#＋＃]*+"
JOIN = rf"(?:[-'’/·‧‐‑‒–−＇／－]{DOT}?|{DOT})"
TAIL = rf"{W}*+{SIGNS}(?:{JOIN}{W}++{SIGNS}){{0,12}}+"
#: A dot in front of a name, as far as a name can start where it stands.
LEAD = rf"(?:(?={DOT})(?<![^\s\p{{Z}}\p{{Ps}}\p{{Pi}}\"'{BEGIN}]){DOT})?"
SMALL = r"[\p{Ll}\p{Lm}\p{M}\p{N}]"
#: Tokens that open a name: with a capital in front, with one inside, or of digits and letters (but no ordinal).
CAPITAL = rf"{LEAD}[\p{{Lu}}\p{{Lt}}]{TAIL}"
INNER = rf"{LEAD}\p{{Ll}}(?={SMALL}{{0,40}}+[+#＋＃]{{0,3}}+(?:{JOIN}{SMALL}{{1,40}}+[+#＋＃]{{0,3}}+){{0,4}}+{JOIN}?\p{{Lu}}){TAIL}"
NUMBER = rf"\p{{Nd}}++(?:{DOT}\p{{Nd}}++){{0,4}}+"
DIGITS = rf"(?!\p{{Nd}}++(?:st|nd|rd|th)(?!{W}|{JOIN}{W})){NUMBER}(?={CASED}|{JOIN}{CASED}){TAIL}"
NAME = rf"(?<!{W})(?:{CAPITAL}|{INNER}|{DIGITS})"
#: A number that isn't a year, counts nothing and begins no word.
VERSION = rf"(?!(?:19|20)\p{{Nd}}{{2}}(?!{W}|{DOT}\p{{Nd}})){NUMBER}(?!{W}|{JOIN}{CASED})(?!{S}++(?i:{'|'.join(COUNTED)})(?!{W}))"
_ENDING = "|".join(r"\.?".join(e) for e in ENDINGS)
GAP = rf"(?:{S}*+[&＆]{S}*+|{STAYS}{S}*+|[.{STAYS}{TITLE}]?,{S}*+(?=(?i:{_ENDING})(?!{W}))|{S}++)"
NEXT = rf"(?:{NAME}|{VERSION}|(?:(?:{'|'.join(JOINING)}){S}++){{1,3}}+{NAME})"

#: A small word other than one that joins a list, not far off: what a clause has and a list of names hasn't.
_SMALL_WORD = rf"[\s\S]{{0,1000}}?(?<![\p{{L}}\p{{N}}'’])(?!(?:and|or)(?!{W}))\p{{Ll}}++(?![\p{{L}}\p{{N}}])"


def _opens(first: str, last: str, gap: str, later: str = "") -> str:
    """An opening mark, unless it puts a single word (of 100 characters at most) in quotes or brackets."""
    return rf"{first}{gap}(?![^\s\p{{Z}}{last}]{{0,100}}[^\s\p{{Z}}{last}.!?…。]{last}{later})"


#: What a clause starts with.
MARKS = rf"{BEGIN}“‘«『「(\[\"':：—―–‒"
CLAUSE = "|".join(
    [
        rf"{BEGIN}{FILL}*?",
        *(_opens(a, b, f"{S}*+") for a, b in ("“”", "‘’", "«»", "『』", "「」")),
        _opens(r"\(", r"\)", f"{S}*+"),
        _opens(r"\[", r"\]", f"{S}*+"),
        _opens(rf"(?<!{W})\"", '"', ""),
        # A later mark behind punctuation is the one that closes.
        _opens(rf"(?<!{W})'", "'", "", r"(?![^']{0,1000}[^\p{L}\p{N}\s]'(?![\p{L}\p{N}]))"),
        rf"[:：]{S}*+(?={_SMALL_WORD})",
        rf"(?<={S})[—―–‒]{S}*+(?={_SMALL_WORD})",
    ]
)
#: How a match starts where a clause starts; a run itself starts with a letter, a digit or a dot.
_FRONT = rf"^(?:{BEGIN}{FILL}*?(?={DOT}?[\p{{L}}\p{{N}}])|[{MARKS}]{S}*+)"
#: Ends of sentences, with what closes behind them; the marks stay. Elsewhere one look at a character is enough.
SENTENCE_END = r"(?=[.!?…。！？\n])(?:([.])[\"'’”»)\]]*[\s\p{Z}]+|([!?…。！？])[\"'’”»)\]』」]*[\s\p{Z}]*|\n\s*)"
#: Numbers and letters of a list.
ITEM = rf"^(?:{FILL}*?(?:(?:\p{{Nd}}+(?:\.\p{{Nd}}+){{0,12}}|[ivxlcdm]+|[a-z])[ \t]*(?:[)\]]|[:.\-–—](?!{W}))|[A-Z][ \t]*[)\]])){{1,3}}"

_WORD = r"\p{Lu}[\p{L}\p{M}\p{N}'’-]*+"
#: The dot behind a capital that is an initial: another in front or behind, joined by dots, a name in front, or two behind.
INITIAL = (
    rf"\.(?={S}++\p{{Lu}})(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])\p{{Lu}}\.)"
    rf"(?:(?<=\.\p{{Lu}}\.)|(?<=(?:^|[\s(\[\"'“‘])\p{{L}}\.[ \t]{{0,3}}\p{{Lu}}\.)|(?={S}++\p{{L}}\.)|(?<=\p{{Lu}}[\p{{L}}\p{{N}}]{{0,30}}[ \t]{{1,3}}\p{{Lu}}\.)|(?=[ \t]*+{_WORD}[ \t]++{_WORD}))"
)
#: A full-width dot that isn't part of a name ends its sentence.
WIDE_STOP = r"．(?!(?<=\p{Nd}．)\p{Nd}|(?<=(?:^|[\s\p{Z}\p{Ps}\p{Pi}])．)\p{L}|(?<=[\p{Lu}\p{Ll}\p{Lt}]．)[\p{Lu}\p{Ll}\p{Lt}]|(?<=\p{Nd}．)\p{Ll}|(?<=[\p{Lu}\p{Ll}\p{Lt}\p{Pd}]\p{Nd}{1,9}．)\p{L})"


def pattern(longest: int) -> str:
    """Finds a run of names, ten times the longest at most, with the mark of a clause in front if there is one."""
    run = rf"{NAME}(?:{GAP}{NEXT}){{0,{10 * longest - 1}}}+"
    # The second form is tried where no mark stands, which is nearly everywhere.
    return rf"(?:(?=[{MARKS}])(?:{CLAUSE}){run}|{run})"


def sentences(text: Column) -> Column:
    """The sentences of a text, marked. Patterns begin with the dot they are about, so other characters cost little."""
    text = F.regexp_replace(text, f"[{STAYS}-{BEGIN}]", " ")
    shorts = lambda words: rf"\.(?={S}++\p{{Lu}})(?<=(?<!{W})(?i:{'|'.join(words)})\.)"
    text = F.regexp_replace(text, shorts(NAME_OPENERS), STAYS)
    text = F.regexp_replace(text, shorts([w for w in SHORT_FORMS if w not in NAME_OPENERS]), TITLE)
    text = F.regexp_replace(text, INITIAL, STAYS)
    text = F.regexp_replace(text, rf"\.(?={S}++\p{{Lu}})(?<=\.\p{{Ll}}\.)", TITLE)
    text = F.regexp_replace(F.regexp_replace(text, WIDE_STOP, "。"), r"\p{Lo}", UNCASED)
    return F.split(F.regexp_replace(text, SENTENCE_END, f"$1$2{BEGIN}"), BEGIN)


def pieces(sentence: Column, longest: int) -> Column:
    """The candidates of a sentence, in order: surface, and whether it opens the sentence or a clause."""
    found = F.regexp_extract_all(F.concat(F.lit(BEGIN), F.regexp_replace(sentence, ITEM, "")), F.lit(pattern(longest)), F.lit(0))
    token = rf"[^\s\p{{Z}}&＆]++(?:{S}*+[&＆]{S}*+[^\s\p{{Z}}&＆]++){{0,40}}+"

    def cut(run: Column) -> Column:
        first = run.rlike(_FRONT)
        # An owner ends its name where another name follows. Splitting at one character compiles no pattern.
        owners = F.split(F.regexp_replace(F.regexp_replace(run, _FRONT, ""), rf"['’＇][sS]{S}++(?={NAME})", BEGIN), BEGIN)
        parts = F.flatten(F.transform(owners, lambda part: F.regexp_extract_all(part, F.lit(rf"{token}(?:{S}++{token}){{0,{longest - 1}}}+"), F.lit(0))))
        return F.transform(parts, lambda part, i: F.struct(F.translate(part, STAYS + TITLE, "..").alias("surface"), (first & (i == 0)).alias("initial")))

    return F.flatten(F.transform(found, cut))


def _batch(column: str | None) -> Column:
    """A batch as a struct, so that null is a batch like others in joins."""
    return F.struct((F.col(column) if column else F.lit(0)).alias("of")).alias("batch")


def candidates(docs: DataFrame, longest: int = 4, batch: str | None = None) -> DataFrame:
    """(batch, doc_id, ordinal, surface, initial, many, name, stem) of docs (doc_id, text): stem is the name without its possessive ending, if it has one. Words that are no names by themselves are among them."""
    cut = docs.select(_batch(batch), "doc_id", F.posexplode(sentences(F.col("text"))).alias("s", "sentence"))
    rows = cut.select("batch", "doc_id", "s", F.posexplode(pieces(F.col("sentence"), longest)).alias("p", "piece")).where(F.col("piece.surface").rlike(r"\p{L}"))
    surface = F.col("piece.surface")
    owner = surface.rlike(r"..['’＇][sSｓＳ]$")
    return rows.select(
        "batch", "doc_id", F.struct("s", "p").alias("ordinal"), surface.alias("surface"), F.col("piece.initial").alias("initial"),
        surface.rlike(r"[^\s\p{Z}&＆][\s\p{Z}&＆]+[^\s\p{Z}&＆]").alias("many"), canonical_name(surface).alias("name"),
        canonical_name(F.when(owner, F.regexp_replace(surface, r"['’＇][sSｓＳ]$", ""))).alias("stem"),
    )


def extract_names(docs: DataFrame, longest: int = 4, ratio: float = 0.5, least_batch: int = 5, least_docs: int = 1, batch: str | None = None) -> DataFrame:
    """(batch, doc_id, name, surface): the names of each document, each once with its first surface.

    batch is a column of docs, or none for one batch of all. longest: tokens of a name; a longer run is cut, not dropped. A name must be in
    least_docs documents; from least_batch documents on it may be in no more than a share of ratio of them.
    """
    # Filters on names stand behind the table, as one pushed down would form them twice.
    nothing = ~F.col("many") & F.col("name").isin(STOPWORDS + SHORT_FORMS)
    found = stored(candidates(docs, longest, batch), "name-candidates").where((F.col("name") != "") & ~nothing).withColumn("stem", F.when(F.col("stem") != F.col("name"), F.col("stem")))
    keys = ["batch", "name"]
    # A possessive is one where the name occurs without it.
    bare = found.where("stem IS NULL").select("batch", F.col("name").alias("stem")).distinct().withColumn("is_bare", F.lit(True))
    owners = found.where("stem IS NOT NULL").join(bare, ["batch", "stem"], "left")
    folded = F.col("is_bare").isNotNull()
    owners = owners.select("batch", "doc_id", "ordinal", F.when(folded, F.regexp_replace("surface", r"['’＇][sSｓＳ]$", "")).otherwise(F.col("surface")).alias("surface"), "initial", "many", F.when(folded, F.col("stem")).otherwise(F.col("name")).alias("name"))
    rows = found.where("stem IS NULL").select(*owners.columns).unionByName(owners)
    # The first surface that counts depends on whether the name stands inside a sentence anywhere in the batch.
    per_doc = rows.groupBy(*keys, "doc_id").agg(
        F.min_by("surface", "ordinal").alias("surface"), F.min_by("surface", F.when(F.col("many") | ~F.col("initial"), F.col("ordinal"))).alias("own_surface"),
        F.bool_or(~F.col("initial")).alias("inside"), F.bool_or(F.col("many") | ~F.col("initial")).alias("own"),
    )
    per_doc = stored(per_doc, "names-by-document")
    by_name = per_doc.groupBy(*keys).agg(F.bool_or("inside").alias("anywhere"), F.count("*").alias("all_docs"), F.count_if("own").alias("own_docs"))
    by_name = by_name.select(*keys, "anywhere", F.when(F.col("anywhere"), F.col("all_docs")).otherwise(F.col("own_docs")).alias("n"))
    sizes = docs.groupBy(_batch(batch)).agg(F.count_distinct("doc_id").alias("size"))
    good = by_name.join(F.broadcast(sizes) if batch is None else sizes, "batch").where((F.col("n") >= least_docs) & ((F.col("size") < least_batch) | (F.col("n") <= F.col("size") * ratio)))
    kept = per_doc.join(good.select(*keys, "anywhere"), keys).where("anywhere OR own")
    return kept.select("batch.of", "doc_id", "name", F.when(F.col("anywhere"), F.col("surface")).otherwise(F.col("own_surface")).alias("surface")).withColumnRenamed("of", "batch")


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name, surface) of the proper names of all documents, as one batch."""
    return extract_names(spread(T.read(spark, sf_dir, "documents")).select("doc_id", "text")).drop("batch")
