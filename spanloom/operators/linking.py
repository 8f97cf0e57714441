"""Dictionary matching, drug names and codes, context flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.text import surface, term, words
from spanloom.operators import bloom
from spanloom.operators.search import dense_topk
from spanloom.operators.spans import anti_overlap, greedy, greedy_by_document
from spanloom.sources.shared import keep

_CI = "(?iu)"


# ---- dictionaries over tokens


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64("gram").alias("_h"), F.xxhash64("gram", F.lit(1)).alias("_g")


def ngrams(tokens: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, ord, n, start, end, gram for 1..n tokens of (doc_id, ord, start, w), joined by one space, lower case.  Tokens
    cut at single spaces that bring those after them (w1, w2, ...) are not shuffled."""
    ready = all(f"w{k}" in tokens.columns for k in range(1, n))
    w = Window.partitionBy("doc_id").orderBy("ord")
    own = F.col("start") + F.length("w")
    if not ready:
        tokens = tokens.select("doc_id", "ord", "start", "w", *[F.lead("w", k).over(w).alias(f"w{k}") for k in range(1, n)], *[F.lead(own, k).over(w).alias(f"e{k}") for k in range(1, n)])
    grams = []
    for k in range(1, n + 1):
        text = F.concat_ws(" ", "w", *[f"w{i}" for i in range(1, k)])
        end = own if k == 1 else F.col("start") + F.length(text) if ready else F.col(f"e{k - 1}")
        grams.append(F.struct(F.lit(k).alias("n"), end.alias("end"), F.when(F.lit(True) if k == 1 else F.col(f"w{k - 1}").isNotNull(), F.lower(text)).alias("gram")))
    grown = tokens.select("doc_id", "ord", "start", F.explode(F.array(*grams)).alias("g"))
    return grown.select("doc_id", "ord", "g.n", "start", "g.end", "g.gram").filter("gram is not null")


def _filter(known: DataFrame) -> Broadcast:
    """A Bloom filter of the grams of ``known``, by two hashes of each."""
    return bloom.words(known.select(F.explode(F.array(*_hashes())).alias("h")).distinct(), "h")


def _passing(grams: DataFrame, table: Broadcast, false: Broadcast | None = None) -> DataFrame:
    """Rows of ``grams`` that the filter lets pass, less those whose hash is in the sorted list ``false``.

    Rows go through Python and come out of it: beside a column function Spark would hold them back on disk."""
    names = grams.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(batch.num_columns - 2).to_numpy()
            out = bloom.hits(table.value, h)
            out[out] = bloom.hits(table.value, batch.column(batch.num_columns - 1).to_numpy()[out])
            if false is not None and len(false.value):
                mine = h[out]
                out[out] = false.value[np.minimum(np.searchsorted(false.value, mine), len(false.value) - 1)] != mine
            yield batch.filter(pa.array(out)).select(names)

    return grams.select("*", *_hashes()).mapInArrow(run, grams.schema)


def dictionary_hits(tokens: DataFrame, dictionary: DataFrame, n: int = 3) -> DataFrame:
    """The n-grams of ``tokens`` that ``dictionary`` (gram, ...) has, with its columns.

    A Bloom filter of its grams goes before the join, so that others are not shuffled."""
    known = keep(dictionary)
    return _passing(ngrams(tokens, n), _filter(known.select("gram").distinct())).join(known, "gram")


MOST_FALSE = 1 << 22  # hashes of n-grams (32 MB) that pass the filter though no dictionary has them


def known_ngrams(tokens: DataFrame, dictionary: DataFrame, n: int = 3) -> tuple[DataFrame, Callable]:
    """The n-grams of ``tokens`` (doc_id, n, start, end, gram) that ``dictionary`` (gram) has, and the greedy selection that
    fits them.  Tokens that bring those after them must come as they were cut, each document's in one partition and in order.

    Of the n-grams only the distinct ones that pass a Bloom filter are shuffled, to learn which of them the dictionary lacks;
    that few 64-bit hashes go to all tasks, and the n-grams themselves stay where documents were cut.  Should those be more than
    MOST_FALSE, a join decides."""
    known = keep(dictionary.select("gram").distinct())
    table = _filter(known)
    grams = ngrams(tokens, n).select("doc_id", "n", "start", "end", "gram")
    lacking = _passing(grams.select("gram"), table).distinct().join(known, "gram", "left_anti").select(_hashes()[0].alias("h")).limit(MOST_FALSE + 1).toArrow()["h"].to_numpy()
    if len(lacking) > MOST_FALSE:
        return _passing(grams, table).join(known, "gram", "left_semi"), greedy
    return _passing(grams, table, tokens.sparkSession.sparkContext.broadcast(np.sort(lacking))), greedy_by_document


def dictionary_longest(tokens: DataFrame, dictionary: DataFrame, n: int = 3) -> DataFrame:
    """Leftmost-longest hits of ``dictionary`` (gram, value): at each token the longest entry, then on after it."""
    return greedy(dictionary_hits(tokens, dictionary, n), [F.col("start"), -F.col("n")], ["gram", "value", "n"])


def known_longest(tokens: DataFrame, dictionary: DataFrame, n: int = 3) -> DataFrame:
    """As ``dictionary_longest``, for tokens as ``known_ngrams`` takes them: values are joined to the hits that are left, the
    least of a gram."""
    known = keep(dictionary)
    hits, claim = known_ngrams(tokens, known, n)
    values = known.groupBy("gram").agg(F.min(F.struct("value")).alias("v")).select("gram", "v.value")
    return claim(hits, [F.col("start"), -F.col("n")], ["gram", "n"]).join(values, "gram").select("doc_id", "start", "end", "gram", "value", "n")


def lexicon_longest_first(hits: DataFrame, claim: Callable = greedy) -> DataFrame:
    """Longest term claims first, wherever it is; ties by term order, then place (start, end, term, term_ord)."""
    return claim(hits, [-F.length("term"), F.col("term_ord"), F.col("start")], ["term", "term_ord"])


def layered_claim(hits: DataFrame, claim: Callable = greedy) -> DataFrame:
    """Layers claim in order (layer 0 first), within a layer longest first."""
    return claim(hits, [F.col("layer"), -(F.col("end") - F.col("start")), F.col("start")], ["layer", "term"])


def repeats(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """Further mentions of known surfaces: occurrences (doc_id, start, end, text, type) that overlap no span, longest first."""
    free = anti_overlap(hits, spans)  # by a window over each document, so its rows follow one another
    return greedy_by_document(free, [-(F.col("end") - F.col("start")), F.col("start")], ["text", "type"])


# ---- clinical drug names


def clinical_name(name: Column) -> Column:
    """struct(ingredient, strength, form) of a name such as "24 HR x 50 MG Extended Release Oral Tablet"; null where it has
    no strength, ingredient or form.  The last strength splits the name."""
    p = r"(?i)^(.*)(?<![\d.])" + vocab.STRENGTH + r"(?!.*(?<![\d.])" + vocab.STRENGTH + r")(.*)$"
    ing = F.trim(F.regexp_extract(name, p, 1))
    ing = F.regexp_replace(F.regexp_replace(F.regexp_replace(ing, r"(?i)^\d+\s*HR\s+", ""), r"^[ ,]+|[ ,]+$", ""), r"(?i)^\d+(?:\.\d+)?\s*ML\s+", "")
    ing = term(F.regexp_replace(ing, r"^[ ,]+|[ ,]+$", ""))
    strength = F.lower(F.concat_ws(" ", F.regexp_extract(name, p, 2), F.regexp_extract(name, p, 3)))
    form = term(F.regexp_extract(name, p, 6))
    ok = name.rlike(p) & (F.trim(F.regexp_extract(name, p, 1)) != "") & (form != "")
    return F.when(ok, F.struct(ing.alias("ingredient"), strength.alias("strength"), form.alias("form")))


def ingredients_only(ingredient: Column) -> Column:
    """Without the strengths that a combination's name still holds."""
    bare = F.regexp_replace(ingredient, "(?i)" + vocab.STRENGTH, "")
    return term(F.regexp_replace(F.regexp_replace(bare, r"\s*/\s*", " / "), r"^[ ,/]+|[ ,/]+$", ""))


def strip_salt(name: Column) -> Column:
    """Drops salt words from the end, but never the only word."""
    return F.regexp_replace(name, r"(?<=\S)(\s+(" + "|".join(vocab.SALTS) + r"))+$", "")


def brand(name: Column) -> Column:
    """The bracketed brand at the end, or null."""
    return F.nullif(term(F.regexp_extract(name, r"\[([^\]]+)\]\s*$", 1)), F.lit(""))


def acceptable(surface_: Column, ingredient: Column) -> Column:
    """May a surface stand for a drug?  Shape and stop lists; whether it is dispensed is a join (``dispensable``)."""
    head = strip_salt(F.element_at(F.split(ingredient, " / "), 1))
    return F.length(surface_).between(4, 40) & surface_.rlike(r"^[a-z][a-z \-]+$") & ~surface_.isin(*vocab.STOP_DRUGS, *vocab.LAB_ANALYTES) & ~head.isin(*vocab.LAB_ANALYTES)


def terminology(clinical: DataFrame, branded: DataFrame) -> dict[str, DataFrame]:
    """From (ord, rxcui, name) tables: full (ingredient, strength, form -> code, first wins), words (of ingredients) and
    brands (brand -> ingredient, first wins)."""
    parsed = clinical.withColumn("p", clinical_name(F.col("name"))).filter("p is not null").select("ord", "rxcui", "p.*")
    full = parsed.groupBy("ingredient", "strength", "form").agg(F.min_by("rxcui", "ord").alias("code"))
    parts = parsed.select(F.explode(F.split("ingredient", " / ")).alias("part"))
    words = parts.select(F.explode(F.array("part", F.split_part("part", F.lit(" "), F.lit(1)))).alias("word")).filter("word <> ''").distinct()
    named = branded.withColumn("brand", brand(F.col("name"))).withColumn("p", clinical_name(F.regexp_replace("name", r"\s*\[[^\]]+\]\s*$", "")))
    brands = named.filter("brand is not null and p is not null").groupBy("brand").agg(F.min_by(ingredients_only(F.col("p.ingredient")), "ord").alias("ingredient"))
    return {"full": full, "words": words, "brands": brands, "parsed": parsed}


def dispensable(names: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of ``names`` (ingredient, ...) whose salt-free first ingredient, or its first word, occurs in ``words``."""
    head = strip_salt(F.element_at(F.split("ingredient", " / "), 1))
    keyed = names.withColumn("_head", head).withColumn("_first", F.split_part("_head", F.lit(" "), F.lit(1)))
    hit = keyed.join(words, (F.col("word") == F.col("_head")), "left_semi").unionByName(keyed.join(words, F.col("word") == F.col("_head"), "left_anti").join(words, F.col("word") == F.col("_first"), "left_semi"))
    return hit.drop("_head", "_first")


def dose(text: Column) -> tuple[Column, Column, Column]:
    """strength, form and extended-release mark read from a span's text; null where absent."""
    unit = F.lower(F.regexp_extract(text, _CI + vocab.DOSE, 2))
    unit = F.when(unit.isin("units", "unit", "đơn vị", "iu"), "unt").otherwise(unit)
    has = text.rlike(_CI + vocab.DOSE)
    strength = F.when(has, F.concat_ws(" ", F.regexp_extract(text, _CI + vocab.DOSE, 1), unit))
    route = F.lower(F.regexp_extract(text, _CI + vocab.ROUTE, 1))
    forms = F.create_map(*[F.lit(x) for kv in vocab.ROUTE_FORM.items() for x in kv])
    return strength, F.when(has & (route != ""), forms[route]), text.rlike(_CI + vocab.EXTENDED_RELEASE)


def resolve_codes(spans: DataFrame, clinical: DataFrame, ingredients: DataFrame) -> DataFrame:
    """id, code, tier for spans (id, text, ingredient), where ``clinical`` is (ingredient, strength, form, code) and
    ``ingredients`` (name, code).

    With a dose: the full key, trying the forms that the route allows in order (1..4); then the only code with that
    strength (5); then the only one of a salt of the ingredient (6).  Else the ingredient's own code: by name (7),
    without its salt (8), or the first of a combination (9).  The lowest tier wins."""
    strength, form, er = dose(F.col("text"))
    s = spans.select("id", "ingredient", strength.alias("strength"), form.alias("form"), er.alias("er"))
    oral = F.array(F.lit("oral tablet"), F.lit("oral capsule"), F.lit("extended release oral tablet"))
    forms = F.when(F.col("form") == "oral tablet", oral).when(F.col("form").isNotNull(), F.array("form"))
    forms = F.when(F.col("er") & F.col("form").isNotNull(), F.concat(F.array(F.lit("extended release oral tablet")), forms)).otherwise(forms)
    tries = s.select("id", "ingredient", "strength", F.posexplode(forms).alias("pos", "form"))
    full = tries.join(clinical, ["ingredient", "strength", "form"]).select("id", (F.col("pos") + 1).alias("tier"), "code")
    by_strength = clinical.groupBy("ingredient", "strength").agg(F.min("code").alias("code"), F.count("*").alias("n")).filter("n = 1")
    only = s.join(by_strength, ["ingredient", "strength"]).select("id", F.lit(5).alias("tier"), "code")
    salts = clinical.withColumn("base", F.regexp_replace("ingredient", r"\s+\S+$", "")).filter("base <> ingredient")
    salted = s.join(salts.select(F.col("base").alias("ingredient"), "strength", "form", "code"), ["ingredient", "strength", "form"]).groupBy("id").agg(F.min("code").alias("code"), F.count_distinct("code").alias("n")).filter("n = 1")
    salted = salted.select("id", F.lit(6).alias("tier"), "code")
    first = F.element_at(F.split("ingredient", " / "), 1)
    names = s.select("id", F.posexplode(F.array("ingredient", strip_salt(F.col("ingredient")), first, strip_salt(first))).alias("pos", "name"))
    own = names.join(ingredients, "name").select("id", (F.least("pos", F.lit(2)) + 7).alias("tier"), "code")
    every = full.unionByName(only).unionByName(salted).unionByName(own)
    best = every.groupBy("id").agg(F.min_by(F.struct("code", "tier"), F.struct("tier", "code")).alias("b"))
    return spans.select("id").join(best, "id", "left").select("id", "b.code", "b.tier")


#: A word's edge where only A-Z, a-z, digits and underscores make words, for texts in lower case.
ASCII_EDGE = r"(?:(?<![0-9a-z_])(?=[0-9a-z_])|(?<=[0-9a-z_])(?![0-9a-z_]))"


def expand_end(text: Column, end: Column, ascii_edges: bool = False) -> Column:
    """The end of a drug span grown over doses, routes and frequencies to its right, stopping before an indication.

    Words end where Unicode letters do; with ``ascii_edges`` any other letter is an edge, as it is for engines whose words are
    ASCII: the "im" of "imß" is a route then."""
    step = r"[\s,]+(?!" + vocab.INDICATION + r")(?:" + vocab.DOSE + "|" + vocab.ROUTE + "|" + vocab.FREQUENCY + ")"
    rest = F.substr(text, end + 1)
    if ascii_edges:
        tail = F.regexp_extract(F.lower(rest), "^(?:" + step.replace(r"\b", ASCII_EDGE) + ")*", 0)
    else:
        tail = F.regexp_extract(rest, r"(?iuU)^(?:" + step + ")*", 0)
    return end + F.length(tail)


# ---- context flags


def context_flags(spans: DataFrame) -> DataFrame:
    """Adds flags to spans (sentence, start, end, historical): the labels whose cues stand before the span.

    A cue counts as a whole word, outside the span, ending before it, at most CUE_GAP characters away with no sentence
    end or "but" between; cues of negation that belong to fixed terms do not.  A historical section gives isHistorical."""
    low = F.lower(F.col("sentence"))
    head = F.substring(low, F.lit(1), F.col("start"))
    flags = [F.when(F.col("historical"), F.lit("isHistorical"))]
    stop = vocab.TERMINATOR
    terms = "|".join(vocab.NOT_NEGATION)
    for label, cues in vocab.CUES.items():
        words = []
        for cue in sorted(cues, key=len, reverse=True):
            body = "".join("\\" + c if not c.isalnum() and c != " " else c for c in cue)
            words.append((r"(?<![\p{L}\p{N}_])" if cue[0].isalnum() else "") + body + (r"(?![\p{L}\p{N}_])" if cue[-1].isalnum() else ""))
        guard = f"(?!{terms})" if label == "isNegated" else ""
        gap = rf"(?:(?!{stop[4:]}).){{0,{vocab.CUE_GAP}}}"
        # the cue, then nothing but a short stretch without a terminator up to the span
        pattern = rf"(?Us){guard}(?:{'|'.join(words)}){gap}$"
        flags.append(F.when(head.rlike(pattern), F.lit(label)))
    return spans.withColumn("flags", F.array_distinct(F.array_compact(F.array(*flags))))


def first_dictionary_entry(text: Column, entries: list[tuple[str, str]]) -> Column:
    """The code of the first entry, in dictionary order, that the text contains; null without one."""
    low = surface(text)
    out = None
    for name, code in entries:
        out = F.when(F.contains(low, F.lit(name)), code) if out is None else out.when(F.contains(low, F.lit(name)), code)
    return out


def is_dosed(text: Column) -> Column:
    """After the first word every other one is a dose, route or frequency."""
    tail = F.regexp_replace(text, r"(?U)^\S+", "")
    return tail.rlike(r"(?iuU)^(?:[\s,]+(?:" + vocab.DOSE + "|" + vocab.ROUTE + "|" + vocab.FREQUENCY + r"))+\s*$")


def force_drugs(spans: DataFrame, index: DataFrame) -> DataFrame:
    """``spans`` with type and forced: spans of other types that are a drug's name (gram of ``index``, the longest of up to
    three words), alone or followed by nothing but amounts, units, routes and frequencies, are drugs; not those that tell of
    poisoning, allergy and the like."""
    word = r"[A-Za-zÀ-ỹ][A-Za-zÀ-ỹ0-9'\-]*"
    t = F.trim("text")
    heads = F.array(*[F.struct(F.lit(n).alias("n"), F.regexp_extract(t, f"^{word}" + rf"(?:[^A-Za-zÀ-ỹ]+{word})" * (n - 1), 0).alias("head")) for n in (3, 2, 1)])
    key = F.struct(*[F.col(c) for c in spans.columns])
    tries = spans.filter((F.col("type") != vocab.DRUG) & (t != "") & ~F.lower(t).rlike(vocab.NO_DRUG)).select(key.alias("k"), t.alias("t"), F.explode(heads).alias("h")).filter("h.head <> ''")
    gram = F.lower(F.array_join(F.regexp_extract_all("h.head", F.lit(word), F.lit(0)), " "))
    named = tries.withColumn("gram", gram).join(index.select("gram").distinct(), "gram", "left_semi").groupBy("k", "t").agg(F.max_by("h.head", "h.n").alias("head"))
    tail = F.filter(F.split(F.substr("t", F.length("head") + 1), r"(?U)\s+"), lambda w: w != "")
    forced = named.filter(F.forall(tail, lambda w: F.lower(w).rlike(vocab.DRUG_TAIL))).select("k.*").distinct()
    keys = [c for c in spans.columns]
    told = spans.join(forced.withColumn("forced", F.lit(True)), keys, "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    return told.withColumn("type", F.when(F.col("forced"), vocab.DRUG).otherwise(F.col("type")))


# ---- codes of spans, by dictionaries and by the nearest entry among codes with a prefix


def by_prefix(codes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of ``codes`` (code, ...) beside each of ``prefixes`` (prefix, ...) that they begin with.

    A code meets its own beginnings, as many as it has characters, in an equi-join; an empty prefix takes every code."""
    own = F.transform(F.sequence(F.lit(0), F.length("code")), lambda n: F.substring(F.col("code"), F.lit(1), n))
    return codes.withColumn("prefix", F.explode(own)).join(prefixes, "prefix")


def code_spans(spans: DataFrame, entries: Mapping[str, Sequence[tuple[str, str]]], valid: DataFrame, index: DataFrame, prefixes: Mapping[str, str], whole: tuple[str, ...] = (vocab.SYMPTOM,)) -> DataFrame:
    """id, code, source (dictionary, index) for spans (id, type, text, embedding); both null where there is no code.

    ``entries`` has for a type its terms and codes, in order: the first whose code is in ``valid`` (code) and whose term the text holds
    counts (for types of ``whole``: is the text, or a word of it).  Spans without one take the code of the most similar row of
    ``index`` (vec_id, code, embedding) among the codes with the prefix that their type has in ``prefixes``; other types get none.
    Dictionaries are closed lists, so they are expressions; the index is searched once for each prefix."""
    known = {r.code for r in valid.filter(F.col("code").isin(*sorted({c for e in entries.values() for _, c in e}))).select("code").distinct().collect()}
    low = F.lower("text")

    def holds(kind: str, term_: str) -> Column:
        return ((low == term_) | F.array_contains(words(low), term_)) if kind in whole else F.contains(low, F.lit(term_))

    rules = [F.when((F.col("type") == kind) & holds(kind, t), F.lit(c)) for kind, e in entries.items() for t, c in e if c in known]
    told = spans.withColumn("_code", F.coalesce(*rules, F.lit(None).cast("string")))
    out = told.filter("_code is not null").select("id", F.col("_code").alias("code"), F.lit("dictionary").alias("source"))
    by_type = spans.sparkSession.createDataFrame(sorted(prefixes.items()), "type string, prefix string")
    masked = keep(by_prefix(index.select("vec_id", "code", "embedding"), by_type.select("prefix").distinct()))
    for prefix in sorted(set(prefixes.values())):
        kinds = [t for t, p in prefixes.items() if p == prefix]
        asked = told.filter(F.col("_code").isNull() & F.col("type").isin(*kinds) & F.col("embedding").isNotNull()).select(F.col("id").alias("query_id"), "embedding")
        rows = masked.filter(F.col("prefix") == prefix)
        near = dense_topk(asked, rows.select("vec_id", "embedding"), 1).join(rows.select("vec_id", "code"), "vec_id")
        out = out.unionByName(near.select(F.col("query_id").alias("id"), "code", F.lit("index").alias("source")))
    return spans.select("id").join(out, "id", "left")
