"""Personal data: pattern spans, and terms that reveal them (DataFrame operations only).

Method. Emails, IP addresses, payment cards and phone numbers are found by pattern; each different
value is a protected entity. Corpus co-occurrence then tells how strongly a word reveals an entity: with counts of
whole documents n(t, e) of word and entity together, n(t), n(e) and N, the disclosure is
PMI(t; e) / IC(e) = log2(n(t,e) N / (n(t) n(e))) / log2(N / n(e)), which is 1 when the word occurs in documents of the
entity only. Counts come from all documents. Pairs seen in fewer than ``MIN_DOCS`` documents have no statistics and
reveal nothing. Every occurrence of a term over ``GENERALISE``, in whatever text, is a span of kind ``term`` and is
generalised to its class; over ``REMOVE`` it is removed. Words are runs of letters and digits outside the spans of entities.

Only words of documents that hold an entity of ``MIN_DOCS`` documents are paired, with such entities only (no other
pair has statistics). The patterns run once over each text; counts are pre-aggregated per task; no position of a word is
shuffled, and nothing is collected.

Possessive quantifiers and the look-behinds leave the matches as they are (the classes around them are disjoint)
and keep the cost linear in long runs; ``\\G`` allows a match right after the last one.

Defined cases: a null text counts as empty and has no span; positions are code points, end exclusive; rows repeated
get equal results; rows that share an id but not the text are told apart by the text's hash; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from care_analytics.llm.common import text_or_empty, written

KINDS = ["email", "ip", "card", "phone"]       # fixed values, in the order of the result
MIN_DOCS = 2               # documents that hold a word and an entity before the pair counts
BLOCK = 256                # matches located in one go: arrays grow by copying
GENERALISE, REMOVE = 0.8, 0.95
TERMS = 100_000            # terms over the threshold that are broadcast; more are joined by a shuffle
DOCUMENTS = 500_000        # ids of documents with a span or a term, likewise
TERM = "array<struct<s:int,e:int,d:double>>"

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold before its pattern is worth running; true for every text with a span that counts.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][ -]?){12}[0-9]", "phone": r"\+[0-9]"}
SPAN = "array<struct<s:int,e:int,v:string>>"
WORDS = r"[\p{L}\p{N}]+"


def _located(text: str, pattern: str) -> str:
    """SQL: the matches of ``pattern`` (an SQL expression) in ``text`` as structs of start, end and value. Starts are running
    lengths of the pieces between matches."""
    return f"""
    aggregate(array(named_struct('m', regexp_extract_all({text}, {pattern}, 0), 'p', split({text}, {pattern}, -1))),
      cast(array() as {SPAN}), (none, f) -> if(size(f.m) = 0, none,
        aggregate(sequence(0, (size(f.m) - 1) div {BLOCK}), named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
          (all, b) -> aggregate(sequence(int(b * {BLOCK}), int(least(size(f.m), (b + 1) * {BLOCK}) - 1)),
            named_struct('at', all.at, 'out', cast(array() as {SPAN})),
            (acc, i) -> named_struct('at', acc.at + length(f.p[i]) + length(f.m[i]), 'out', array_append(acc.out, named_struct(
              's', acc.at + length(f.p[i]), 'e', acc.at + length(f.p[i]) + length(f.m[i]), 'v', f.m[i]))),
            acc -> named_struct('at', acc.at, 'out', array_append(all.out, acc.out))),
          all -> flatten(all.out))))"""


_LUHN = """aggregate(sequence(0, length(d) - 1), 0, (sum, i) -> sum + if(i % 2 = 0, int(substr(d, length(d) - i, 1)),
    int(substr(d, length(d) - i, 1)) * 2 - if(int(substr(d, length(d) - i, 1)) > 4, 9, 0))) % 10 = 0"""
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.v, r'\\.'), part -> part rlike r'^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
    "card": "exists(array(regexp_replace(x.v, '[^0-9]', '')), d -> length(d) between 13 and 19 and " + _LUHN + ")",
    "phone": "length(regexp_replace(x.v, '[^0-9]', '')) between 9 and 15",
}


def base_spans(text: Column | str, kind: str) -> Column:
    """Spans of ``kind`` in a text column: leftmost, not overlapping, those that fail the check dropped."""
    name = text if isinstance(text, str) else "__text"
    gate = f"contains({name}, '@')" if kind == "email" else f"{name} rlike r'{GATES[kind]}'"
    return F.expr(f"if({gate}, filter({_located(name, f"r'{PATTERNS[kind]}'")}, x -> {CHECKS[kind]}), cast(array() as {SPAN}))")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __key, __text, email, ip, card, phone): ``__key`` is the hash of the text."""
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")) \
        .withColumn("__key", F.xxhash64("__text"))
    return rows.select("__id", "__key", "__text", *[base_spans("__text", k).alias(k) for k in KINDS])


# SQL: the text with spaces in place of its spans.
OUTSIDE = f"""aggregate(array(sort_array(transform(concat({', '.join(KINDS)}), x -> named_struct('s', x.s, 'e', x.e)))), __text, (whole, spans) ->
    if(size(spans) = 0, whole, aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, x) -> if(x.e <= acc.at, acc,
        named_struct('at', x.e, 'out', array_append(acc.out, concat(substr(whole, acc.at + 1, greatest(x.s - acc.at, 0)),
            repeat(' ', x.e - greatest(x.s, acc.at)))))), acc -> concat(array_join(acc.out, ''), substr(whole, acc.at + 1)))))"""
DIFFERENT = f"array_distinct(transform(regexp_extract_all(__outside, r'{WORDS}', 0), x -> lower(x)))"


def outside(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __key, __outside): each text with spaces in place of its spans."""
    return _rows(docs, id_col, text_col).select("__id", "__key", F.expr(OUTSIDE).alias("__outside"))


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __key, __sha, email, ip, card, phone, __words): the spans of each row, its different words outside them, in lower
    case, and the SHA-256 of its text. The patterns run here and nowhere else."""
    return _rows(docs, id_col, text_col).withColumn("__outside", F.expr(OUTSIDE)) \
        .select("__id", "__key", F.sha2("__text", 256).alias("__sha"), *KINDS, F.expr(DIFFERENT).alias("__words"))


def disclosures(base: DataFrame, min_docs: int = MIN_DOCS, threshold: float = GENERALISE) -> DataFrame:
    """(__kind, __value, __term, __disclosure): the terms that reveal entities over ``threshold``. Counts are of rows; rows
    repeated under one id are one document for ``min_docs``."""
    different = F.array_distinct(F.concat(*[F.expr(f"transform({k}, x -> named_struct('k', '{k}', 'v', x.v))") for k in KINDS]))
    holders = base.filter(F.size(F.concat(*KINDS)) > 0).groupBy("__id", "__key").agg(
        F.count(F.lit(1)).alias("__rows"), F.first(different).alias("__all"), F.first("__words").alias("__words"))
    held = written(holders.select("__rows", "__words", F.explode("__all").alias("__x"))
                   .select("__rows", "__words", F.col("__x.k").alias("__kind"), F.col("__x.v").alias("__value")), "pii-held")
    entities = held.groupBy(F.col("__kind").alias("__k"), F.col("__value").alias("__v")) \
        .agg(F.sum("__rows").alias("__ne"), F.count(F.lit(1)).alias("__docs")).filter(F.col("__docs") >= min_docs).drop("__docs")
    entities = written(entities, "pii-entities")
    same = (F.col("__kind") == F.col("__k")) & (F.col("__value") == F.col("__v"))
    together = held.join(entities, same, "left_semi") \
        .select("__kind", "__value", "__rows", F.explode("__words").alias("__term")).groupBy("__kind", "__value", "__term") \
        .agg(F.sum("__rows").alias("__te"), F.count(F.lit(1)).alias("__docs")).filter(F.col("__docs") >= min_docs).drop("__docs")
    together = written(together, "pii-pairs")
    # Words are counted before they meet the pairs, so a map task sends each of its words once.
    of_word = base.select(F.explode("__words").alias("__w")).groupBy("__w").agg(F.count(F.lit(1)).alias("__nt"))
    total = base.agg(F.count(F.lit(1)).alias("__n"))
    pairs = together.join(of_word, F.col("__term") == F.col("__w")).join(entities, same) \
        .withColumn("__n", F.lit(total.first()["__n"]))
    information = F.log2(F.col("__n") / F.col("__ne"))
    revealed = F.log2(F.col("__te") * F.col("__n") / (F.col("__nt") * F.col("__ne")))
    return pairs.filter(F.col("__n") > F.col("__ne")) \
        .select("__kind", "__value", "__term", (revealed / information).alias("__disclosure")) \
        .filter(F.col("__disclosure") >= threshold)


def small(df: DataFrame, bound: int) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``bound`` rows; the join gives the same rows either way."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


# SQL: the text with entities as [kind], revealing terms as [number], [name] or [word] (``null``) or as nothing.
_CLEAN = r"""aggregate(__marks, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, x) -> if(x.s < acc.at, acc, named_struct('at', -x.e,
    'out', array_append(array_append(acc.out, substr(__text, acc.at + 1, x.s - acc.at)), coalesce(x.as,
        case when substr(__text, x.s + 1, -x.e - x.s) rlike r'^\p{N}' then '[number]'
             when substr(__text, x.s + 1, 1) rlike r'\p{Lu}' then '[name]' else '[word]' end)))),
    acc -> concat(array_join(acc.out, ''), substr(__text, acc.at + 1)))"""


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, threshold: float = GENERALISE,
           remove: float = REMOVE) -> DataFrame:
    """One row per input row: (__id, __key, __sha, email, ip, card, phone, term, __clean): all spans, and the sanitised text, which is
    null where it is the text as it was.

    The terms of a document are joined to it as one small list, from its different words; only documents with a span or a term are
    read again, and their occurrences are located within the row."""
    base = written(find_base(docs, id_col, text_col), "pii-base")
    over = written(disclosures(base, min_docs, threshold).groupBy(F.col("__term").alias("__t")).agg(F.max("__disclosure").alias("__d")), "pii-over")
    hits = base.select("__id", "__key", F.explode("__words").alias("__w")).join(small(over, TERMS), F.col("__w") == F.col("__t")) \
        .groupBy(F.col("__id").alias("__hid"), F.col("__key").alias("__hkey")).agg(F.collect_set(F.struct("__t", "__d")).alias("__hits"))
    all_rows = written(base.drop("__words").join(hits, F.col("__id").eqNullSafe(F.col("__hid")) & (F.col("__key") == F.col("__hkey")), "left")
                       .drop("__hid", "__hkey"), "pii-marks")
    some = (F.size(F.concat(*KINDS)) > 0) | F.col("__hits").isNotNull()
    busy = all_rows.filter(some).dropDuplicates(["__id", "__key"]).withColumnsRenamed({"__id": "__bid", "__key": "__bkey"})
    same = F.col("__id").eqNullSafe(F.col("__bid")) & (F.col("__key") == F.col("__bkey"))
    texts = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")).withColumn("__key", F.xxhash64("__text"))
    texts = texts.join(small(busy.select("__bid", "__bkey"), DOCUMENTS), same, "left_semi").join(busy, same)
    # The words of the text that are terms, as they are written there, make a pattern of their own; only its matches are located.
    written_so = f"if(__hits is null, array(), filter(array_distinct(regexp_extract_all(__outside, r'{WORDS}', 0)), w -> exists(__hits, h -> h.__t = lower(w))))"
    whole = r"concat(r'(?<![\p{L}\p{N}])(?:', array_join(__so, '|'), r')(?![\p{L}\p{N}])')"
    found = f"""if(size(__so) = 0, cast(array() as {TERM}), transform({_located('__outside', '__pattern')},
        x -> named_struct('s', x.s, 'e', x.e, 'd', filter(__hits, h -> h.__t = lower(x.v))[0].__d)))"""
    parts = [F.expr(f"transform({k}, x -> named_struct('s', x.s, 'e', -x.e, 'as', '[{k}]'))") for k in KINDS]
    parts.append(F.expr(f"transform(term, x -> named_struct('s', x.s, 'e', -x.e, 'as', if(x.d >= {remove}, '', null)))"))
    located = texts.withColumn("__outside", F.expr(OUTSIDE)).withColumn("__so", F.expr(written_so)).withColumn("__pattern", F.expr(whole)) \
        .withColumn("term", F.expr(found)).withColumn("__marks", F.sort_array(F.concat(*parts))) \
        .select("__id", "__key", "__sha", *KINDS, "term", F.expr(_CLEAN).alias("__clean"))
    quiet = all_rows.filter(~some).select("__id", "__key", "__sha", *KINDS, F.expr(f"cast(array() as {TERM})").alias("term"), F.lit(None).cast("string").alias("__clean"))
    return quiet.unionByName(located)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
         threshold: float = GENERALISE) -> DataFrame:
    """One row per input row: (__id, __key, email, ip, card, phone, term), arrays of spans; a term span has its
    largest disclosure as ``d``."""
    return marked(docs, id_col, text_col, min_docs, threshold).select("__id", "__key", *KINDS, "term")


def joined(kinds: list[str]) -> Column:
    """kind:start:end of the span columns named, by kind and start, comma-joined."""
    return F.concat_ws(",", F.concat(*[F.expr(f"transform({k}, x -> concat('{k}:', x.s, ':', x.e))") for k in kinds]))


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
             threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per input row: (id, text): entities become ``[kind]``, revealing terms ``[number]``, ``[name]`` or ``[word]``
    (generalised) or nothing (removed). Where spans overlap, the one that starts first, then the longest, counts."""
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    clean = marked(docs, id_col, text_col, min_docs, threshold, remove).filter("__clean is not null") \
        .select(F.col("__id").alias("__sid"), F.col("__key").alias("__skey"), "__clean").dropDuplicates(["__sid", "__skey"])
    return rows.join(clean, F.col(id_col).eqNullSafe(F.col("__sid")) & (F.col("__hash") == F.col("__skey")), "left") \
        .select(F.col(id_col), F.coalesce("__clean", "__text").alias(text_col))
