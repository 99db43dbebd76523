"""Personal data: patterns find what must be protected, corpus co-occurrence finds the words that give it away.

The base finds e-mail addresses, IP addresses, card and telephone numbers.  Each value found is a protected entity ``c``.
Words of the documents it stands in are judged by what they tell about it: over all documents, ``PMI(c; t) = log2(p(c, t) / (p(c)
p(t)))`` is the information a word ``t`` carries about ``c``, ``IC(c) = -log2 p(c)`` all there is.  A word that discloses at
least ``alpha`` of that is generalised to its first letters if those, counted over the corpus in the same way, stay below
the threshold, and else removed.

Everything is built-in DataFrame functions.  Positions come from a fold over the matches and the text between them; the
patterns are the usual ones, with possessive repeats and look-behinds that keep them linear on long runs without changing
what they match.

Defined handling: a null text counts as empty.  Documents that repeat an id or a text are documents of their own, and counts
go over all of them.  An entity that stands in every document carries no information and adds no span.  A word found together
with an entity in fewer than ``support`` documents is not judged: a single meeting is no estimate.  An empty table gives no
rows.  Columns besides id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import col, materialise

#: Kinds in the order in which spans of the same start are listed; the last two are added by co-occurrence.
KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
GENERALISE, REMOVE = 4, 5

_LOCAL = r"[A-Za-z0-9._%+-]"
#: A match starts where a run of its characters starts, or where the match before ended: from there it would be found first.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # 14 to 19 digits, neither preceded nor followed by more of the same number
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Words: all but ASCII signs and white space.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"
#: First letters that stand for a word when it is generalised.
PREFIX = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = lambda i: F.substr(digits, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
    total = F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda a, i: a + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # leading zeros do not count
        return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: int, keep=None, offset: Column | None = None) -> Column:
    """The spans of all leftmost matches that ``keep`` takes, in code points, as an array of SPAN rows.

    The matches and the pieces between them are folded once; each match starts where the lengths before it end."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.struct((offset if offset is not None else F.lit(0)).cast("int").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        piece, found = pair["piece"], pair["found"]
        start = state["at"] + F.char_length(piece)
        stop = start + F.char_length(found)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), found.alias("value"))
        grown = F.concat(state["spans"], F.array(span))
        return F.struct(stop.alias("at"), (grown if keep is None else F.when(keep(found), grown).otherwise(state["spans"])).alias("spans"))

    return F.aggregate(F.filter(pairs, lambda pair: pair["found"].isNotNull()), none, step, lambda state: state["spans"])


def base_spans(text: Column) -> Column:
    """All spans of the four patterns that pass their checks, by start and kind."""
    none = F.array().cast(SPAN)
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = matches(text, pattern, number, lambda value, kind=kind: _valid(kind, value))
        sign = {"email": "@", "phone": "+"}.get(kind)
        found.append(F.when(F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9]"), spans).otherwise(none))
    return F.array_sort(F.concat(*found))


def merged(spans: Column) -> Column:
    """Spans that overlap as one stretch: its begin, end and the entities in it."""
    none = F.array().cast("array<struct<begin:int,end:int,entities:array<string>>>")

    def step(held: Column, span: Column) -> Column:
        entity = F.array(F.concat(F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1), F.lit(":"), F.lower(span["value"])))
        last = F.element_at(held, -1)
        new = F.struct(span["start"].alias("begin"), span["stop"].alias("end"), entity.alias("entities"))
        wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["stop"]).alias("end"), F.array_union(last["entities"], entity).alias("entities"))
        apart = (F.size(held) == 0) | (span["start"] >= last["end"])
        return F.when(apart, F.concat(held, F.array(new))).otherwise(F.concat(F.slice(held, 1, F.size(held) - 1), F.array(wider)))

    return F.aggregate(spans, none, step)


def contexts(text: Column, stretches: Column, window: int | None) -> Column:
    """For each stretch its entities and the text up to ``window`` code points before and after it, whole words only.

    Neighbouring stretches end a context.  Without a window there is one context for each piece of text between stretches,
    and every entity of the text belongs to it."""
    if window is None:
        entities = F.array_distinct(F.flatten(F.transform(stretches, lambda s: s["entities"])))

        def piece(stretch: Column, i: Column) -> Column:
            floor = F.when(i > 0, F.get(stretches, i - 1)["end"]).otherwise(0)
            left = F.substr(text, floor + 1, stretch["begin"] - floor)
            right = F.when(i == F.size(stretches) - 1, F.substr(text, stretch["end"] + 1, F.char_length(text))).otherwise(F.lit(""))
            return F.struct(entities.alias("entities"), stretch["begin"].alias("begin"), stretch["end"].alias("end"), left.alias("left"), right.alias("right"))

        return F.transform(stretches, piece)

    def around(stretch: Column, i: Column) -> Column:
        floor = F.when(i > 0, F.get(stretches, i - 1)["end"]).otherwise(0)
        ceiling = F.when(i < F.size(stretches) - 1, F.get(stretches, i + 1)["begin"]).otherwise(F.char_length(text))
        # one code point more shows whether the window cuts a word
        begin = F.greatest(floor, stretch["begin"] - window - 1)
        end = F.least(ceiling, stretch["end"] + window + 1)
        left = F.substr(text, begin + 1, stretch["begin"] - begin)
        left = F.when(begin > floor, F.regexp_replace(left, f"(?s)^(?:{WORD}++|.)", "")).otherwise(left)
        right = F.substr(text, stretch["end"] + 1, end - stretch["end"])
        right = F.when(end < ceiling, F.regexp_replace(right, f"(?s)(?:{WORD}++|.)$", "")).otherwise(right)
        return F.struct(stretch["entities"].alias("entities"), stretch["begin"].alias("begin"), stretch["end"].alias("end"), left.alias("left"), right.alias("right"))

    return F.transform(stretches, around)


def find(docs: DataFrame, id_col: str, text_col: str, window: int | None, keep_text: bool) -> DataFrame:
    """Per document: key, id, base spans, contexts; written once, without the text unless asked for."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumn("spans", base_spans(F.col("text"))).withColumn("stretches", merged(F.col("spans")))
    rows = rows.withColumn("contexts", contexts(F.col("text"), F.col("stretches"), window))
    return materialise(rows.select("key", "id", "spans", "contexts", *(["text"] if keep_text else [])), "personal")


def holdings(found: DataFrame) -> DataFrame:
    """The number of documents that hold an entity: entity, holding."""
    return found.select(F.explode(F.array_distinct(F.flatten(F.col("contexts.entities")))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("holding"))


def context_words(found: DataFrame, counts: DataFrame, alpha: float, support: int) -> DataFrame:
    """One row for each entity and each word of its contexts that can be judged: key, entity, term, start, stop.

    An entity in fewer than ``support`` documents meets no word often enough.  An entity and a word meet in at most as many
    documents as hold the entity, so a word in more than total * (holding / total) ** alpha documents cannot disclose enough;
    the largest holding of a document's entities bounds its words before they are paired."""
    total = float(found.count())
    rows = found.select("key", F.posexplode("contexts").alias("place", "c")).select("key", "place", "c.*")
    known = holdings(found).where((F.col("holding") >= support) & (F.col("holding") < total))
    least = F.lit(total) * F.pow(F.col("holding") / F.lit(total or 1.0), F.lit(float(alpha))) * (1 + 1e-9)
    pairs = rows.select("key", "place", F.explode("entities").alias("entity")).join(known.withColumn("most", least), "entity").select("key", "place", "entity", "most")
    pairs = materialise(pairs, "holders")
    kept = pairs.groupBy("key", "place").agg(F.max("most").alias("widest"))
    left = matches(F.col("left"), WORD + "+", 0, offset=F.col("begin") - F.char_length("left"))
    right = matches(F.col("right"), WORD + "+", 0, offset=F.col("end"))
    words = rows.join(kept, ["key", "place"]).select("key", "place", "widest", F.explode(F.concat(left, right)).alias("word"))
    words = words.select("key", "place", "widest", F.lower("word.value").alias("term"), "word.start", "word.stop")
    rare = words.join(counts.select(F.col("unit").alias("term"), F.col("documents")), "term").where(F.col("documents") <= F.col("widest"))
    met = rare.drop("widest").join(pairs, ["key", "place"]).where(F.col("documents") <= F.col("most"))
    return materialise(met.select("key", "entity", "term", "start", "stop"), "contexts")


def general_form(term: Column) -> Column:
    """The first letters of a word, marked by a sign that no word has; null for words that have no more than these."""
    return F.when(F.char_length(term) > PREFIX, F.concat(F.substring(term, 1, PREFIX), F.lit("*")))


def document_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """The number of documents of every word and general form of the corpus: unit, documents."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(col(text_col).cast("string"), F.lit(""))), SEPARATOR + "+"))
    forms = F.array_distinct(F.transform(F.col("words"), general_form))
    units = docs.select(words.alias("words")).select(F.explode(F.concat("words", forms)).alias("unit"))
    return units.groupBy("unit").agg(F.count(F.lit(1)).alias("documents"))


def disclosures(words: DataFrame, found: DataFrame, counts: DataFrame, alpha: float, support: int) -> DataFrame:
    """The pairs of entity and word that disclose too much: entity, term, kind (generalise or remove), disclosed share."""
    total = F.lit(float(found.count()))
    entities = holdings(found)
    units = words.select("key", "entity", "term", general_form(F.col("term")).alias("form"))
    met = units.select("key", "entity", F.explode(F.array("term", "form")).alias("unit")).where("unit IS NOT NULL").distinct()
    joint = met.groupBy("entity", "unit").agg(F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= support)
    known = materialise(joint.join(counts, "unit").join(entities, "entity"), "joint")
    pmi = F.log2(F.col("joint") * total / (F.col("holding").cast("double") * F.col("documents")))
    told = known.where(F.col("holding") < total).withColumn("disclosed", pmi / F.log2(total / F.col("holding"))).where(F.col("disclosed") >= alpha)
    terms = told.where(~F.col("unit").endswith("*")).select("entity", F.col("unit").alias("term"), "disclosed").withColumn("form", general_form(F.col("term")))
    forms = told.where(F.col("unit").endswith("*")).select("entity", F.col("unit").alias("form"), F.lit(True).alias("too_narrow"))
    judged = terms.join(forms, ["entity", "form"], "left")
    wide = F.col("form").isNotNull() & F.col("too_narrow").isNull()
    return judged.select("entity", "term", F.when(wide, GENERALISE).otherwise(REMOVE).alias("kind"), "disclosed")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind, generalised words by their first letters, the rest by an ellipsis."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        named = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1), F.lit("]"))
        shown = F.concat(F.substr(text, span["start"] + 1, F.lit(PREFIX)), F.lit("…"))
        instead = F.when(span["kind"] == GENERALISE, shown).when(span["kind"] == REMOVE, F.lit("…")).otherwise(named)
        before = F.substr(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        out = F.concat(state["out"], before, F.when(span["start"] >= state["at"], instead).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1, F.char_length(text))))


def named(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.75, support: int = 2, window: int | None = None, keep_text: bool = False
) -> DataFrame:
    """Per document: id, base (spans of the patterns), spans (all, by start and kind) and, if asked for, sanitised (the text).

    ``window`` is the reach of a context in code points (without one, all words of the document are judged), ``alpha`` the share of an entity's information that a word may
    not disclose, ``support`` the least number of documents in which word and entity meet.
    """
    found = find(docs, id_col, text_col, window, keep_text)
    counts = materialise(document_counts(docs, text_col), "counts")
    words = context_words(found, counts, alpha, support)
    pairs = disclosures(words, found, counts, alpha, support)
    added = words.join(pairs, ["entity", "term"]).groupBy("key", "start", "stop").agg(F.max("kind").alias("kind"), F.first("term").alias("value"))
    lists = added.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "stop", "value")).alias("added"))
    made = found.join(lists, "key", "left")
    every = F.array_sort(F.concat("spans", F.coalesce(F.col("added"), F.array().cast(SPAN))))
    made = made.select(F.col("id").alias(id_col), F.col("spans").alias("base"), every.alias("spans"), *(["text"] if keep_text else []))
    return made.select(id_col, "base", "spans", sanitised(F.col("text"), F.col("spans")).alias("sanitised")) if keep_text else made
