"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram over character classes and its histogram over common
words are compared with the references of its language by the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1). A reference is the
sum of the histograms of all documents of that language that pass the base
rules, so each statistic covers the whole corpus. A verdict needs a minimum
length: shorter histograms are not judged by that rule.

Defined results: a null text counts as empty (no words; it fails the base
rules). A null or unknown language belongs to the group ``other``. Repeated
rows get equal results. Columns named like an output are replaced. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE, WORD, written

# Common words of each language whose frequencies are compared.
COMMON_WORDS = {
    "en": ["a", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "fr": ["au", "avec", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "qui", "sur", "un", "une"],
    "de": ["auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "im", "in", "mit", "nicht", "sich", "und", "von", "zu"],
    "es": ["con", "de", "del", "el", "en", "es", "esta", "la", "las", "los", "no", "para", "por", "que", "se", "un", "una", "y"],
}
# Character classes as regular expressions; what is left is the last class.
CLASSES = {
    "lower": "[a-z]",
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "space": SPACE,
    "stop": "[.,;:'\"!?()-]",
    "symbol": "[#*$%&|<>]",
}
#: Histograms with less are not judged.
MIN_CHARS, MIN_WORDS = 200, 100
#: Largest distance of a kept document.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.27


def _chars(text: str, of: str) -> Column:
    """Characters of a class, by what is left without them (Spark's translate looks up every character in a map)."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{of}+", ""))).cast("long")


def _repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words in 3-word windows found twice or more.

    Windows are sorted by hash; those equal to a neighbour are repeats. A
    window that starts d words after the last repeated one adds min(d, 3).
    """
    hashes = F.expr(f"CASE WHEN size({words}) < 4 THEN array() ELSE transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])) END")
    # most texts repeat no window: only the others are sorted
    windows = F.expr("CASE WHEN size(array_distinct(_hashes)) = size(_hashes) THEN array() ELSE sort_array(transform(_hashes, (h, i) -> struct(h AS h, i AS i))) END")
    repeated = F.expr("CASE WHEN size(_w) = 0 THEN array() ELSE array_sort(transform(filter(_w, (x, k) -> (k > 0 AND x.h = _w[k - 1].h) OR (k + 1 < size(_w) AND x.h = _w[k + 1].h)), x -> x.i)) END")
    covered = F.expr("aggregate(_r, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(i - a.last, 3) AS n, i AS last), a -> a.n)")
    return df.withColumn("_hashes", hashes).withColumn("_w", windows).withColumn("_r", repeated).withColumn(out, covered).drop("_hashes", "_w", "_r")


def measures(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the base counts, ``base_failed`` and the two histograms (arrays of counts)."""
    outs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lang_group", "char_hist", "word_hist"]
    docs = docs.drop(*outs)
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_t", t).withColumn("_words", F.filter(F.split("_t", f"{SPACE}+"), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(WORD))))
    group = F.lit("other")
    for name in COMMON_WORDS:
        group = F.when(F.col(lang) == name, name).otherwise(group)
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.length("_t") - _chars("_t", SPACE)).cast("long"),
            "n_symbols": _chars("_t", CLASSES["symbol"]),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "lang_group": group,
        }
    )
    df = _repeat_words(df, "_words", "n_repeat_words")
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    own = {"lower": F.length(F.regexp_replace("_t", "[^a-z]+", "")).cast("long"), "symbol": F.col("n_symbols"), "space": F.length("_t") - F.col("word_chars")}
    counted = [own.get(name, _chars("_t", of)).cast("long") for name, of in CLASSES.items()]
    df = df.withColumn("_c", F.array(*counted)).withColumn("char_hist", F.expr("array_append(_c, cast(length(_t) AS bigint) - aggregate(_c, 0L, (a, x) -> a + x))"))
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    written_as = ", ".join(repr(w) for word in every for w in dict.fromkeys((word, word.capitalize())))
    df = df.withColumn("_common", F.expr(f"filter(_words, w -> w IN ({written_as}))"))
    vocab = F.array(*map(F.lit, every))
    for name, words in COMMON_WORDS.items():
        vocab = F.when(F.col("lang_group") == name, F.array(*map(F.lit, words))).otherwise(vocab)
    df = df.withColumn("_v", vocab).withColumn("_at", F.expr("transform(_common, w -> array_position(_v, lower(w)))"))
    df = df.withColumn("_h", F.expr("transform(sequence(1, size(_v)), i -> cast(size(_at) - size(array_remove(_at, cast(i AS bigint))) AS bigint))"))
    df = df.withColumn("word_hist", F.expr("array_append(_h, n_words - aggregate(_h, 0L, (a, x) -> a + x))"))
    return df.drop("_t", "_words", "_lines", "_c", "_common", "_v", "_at", "_h")


def references(measured: DataFrame) -> DataFrame:
    """Summed histograms of the documents that pass the base rules: one row a language group, five at most."""
    width = len(CLASSES) + 1
    wide = len({w for words in COMMON_WORDS.values() for w in words}) + 1
    # a condition in the sums, not a filter: a filter would be pushed below the projections and repeat their work for each element
    total = lambda hist, i: F.sum(F.when(~F.col("base_failed"), F.get(hist, F.lit(i))))
    sums = [total("char_hist", i).alias(f"c{i}") for i in range(width)] + [total("word_hist", i).alias(f"w{i}") for i in range(wide)]
    by = measured.groupBy("lang_group").agg(*sums)
    chars = F.array(*[F.col(f"c{i}") for i in range(width)])
    words = F.filter(F.array(*[F.col(f"w{i}") for i in range(wide)]), lambda x: x.isNotNull())
    return by.select("lang_group", chars.alias("char_ref"), words.alias("word_ref"))


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null where either sums to nothing."""
    sums = f"aggregate({p}, 0L, (a, x) -> a + x)", f"aggregate({q}, 0L, (a, x) -> a + x)"
    term = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0D END"
    pairs = f"zip_with(transform({p}, x -> x / {sums[0]}), transform({q}, y -> y / {sums[1]}), (x, y) -> {term.format(x='x', y='y')} + {term.format(x='y', y='x')})"
    return F.expr(f"CASE WHEN {sums[0]} > 0 AND {sums[1]} > 0 THEN sqrt(greatest(aggregate({pairs}, 0D, (a, x) -> a + x) / 2, 0D)) END")


def _judged(measured: DataFrame, corpus: DataFrame, max_char: float, max_word: float) -> DataFrame:
    """measured with its distances to the references of corpus, and ``kept``."""
    # five rows at most: the groups are the fixed languages and "other"
    df = measured.join(F.broadcast(references(corpus)), "lang_group", "left")
    df = df.withColumn("char_distance", F.when(F.aggregate("char_hist", F.lit(0).cast("long"), lambda a, x: a + x) >= MIN_CHARS, _distance("char_hist", "char_ref")))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, _distance("word_hist", "word_ref")))
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return df.withColumn("kept", ~F.col("base_failed") & ~far).drop("char_hist", "word_hist", "char_ref", "word_ref", "lang_group")


def verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """docs without the text, with the base counts, both distances and ``kept``; the texts are read once."""
    docs = docs.drop("char_distance", "word_distance", "kept", "char_ref", "word_ref")
    measured = written(measures(docs, text, lang).drop(text), "quality-measures")
    return _judged(measured, measured, max_char, max_word)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """docs with the base counts, both distances and ``kept``, for callers that need the texts too.

    The references come from a table of the measures; the texts are measured
    again on the way out, which costs less than sorting them into a join.
    """
    docs = docs.drop("char_distance", "word_distance", "kept", "char_ref", "word_ref")
    found = written(measures(docs, text, lang).select("lang_group", "base_failed", "char_hist", "word_hist"), "quality-measures")
    return _judged(measures(docs, text, lang), found, max_char, max_word)


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with docs' columns.

    Kept rows are exploded once, others not at all: a filter would be pushed
    below the projections, which repeats their work for each array element.
    """
    judged = judge(docs, text, lang)
    return judged.withColumn("_keep", F.explode(F.when(F.col("kept"), F.array(F.lit(True))))).select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    classes = ", ".join(f"('{name}', length(t) - length(regexp_replace(t, '{of.replace(chr(39), chr(39) * 2)}+', '', 'g')))" for name, of in CLASSES.items())
    vocab = ", ".join(f"('{lang}', '{w}')" for lang, words in [*COMMON_WORDS.items(), ("other", sorted({w for ws in COMMON_WORDS.values() for w in ws}))] for w in words)
    distance = """
      SELECT h.doc_id, sqrt(greatest(sum(
          CASE WHEN h.n > 0 THEN h.n / h.s * log2(2 * (h.n / h.s) / (h.n / h.s + r.n / r.s)) ELSE 0 END
        + CASE WHEN r.n > 0 THEN r.n / r.s * log2(2 * (r.n / r.s) / (h.n / h.s + r.n / r.s)) ELSE 0 END) / 2, 0)) AS dist
      FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS s FROM {h}) h
      JOIN (SELECT g, k, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY g)::DOUBLE AS s FROM {h} JOIN (SELECT doc_id, base_failed FROM base) USING (doc_id) WHERE NOT base_failed GROUP BY g, k) r USING (g, k)
      WHERE h.s >= {least} AND r.s > 0 GROUP BY h.doc_id"""
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(repr(x) for x in COMMON_WORDS)}) THEN lang ELSE 'other' END AS g FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    win AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) >= 2),
    cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id),
    base AS (
      SELECT w.doc_id, g, t, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(cov.n, 0) > 50 * len(ws) AS base_failed
      FROM w LEFT JOIN cov USING (doc_id)),
    chars AS (
      SELECT doc_id, g, k, n FROM base, LATERAL (VALUES {classes}) AS c(k, n)
      UNION ALL SELECT doc_id, any_value(g), 'rest', any_value(length(t)) - sum(n) FROM base, LATERAL (VALUES {classes}) AS c(k, n) GROUP BY doc_id),
    vocab AS (SELECT * FROM (VALUES {vocab}) AS v(g, k)),
    seen AS (SELECT doc_id, g, lower(x) AS k, count(*) AS n FROM base, unnest(ws) AS u(x) WHERE x = lower(x) OR x = upper(x[1]) || lower(x[2:]) GROUP BY ALL),
    common AS (SELECT b.doc_id, b.g, v.k, coalesce(s.n, 0) AS n FROM base b JOIN vocab v ON v.g = b.g LEFT JOIN seen s ON s.doc_id = b.doc_id AND s.k = v.k),
    hist AS (SELECT * FROM common UNION ALL SELECT doc_id, any_value(b.g), '', any_value(n_words) - sum(c.n) FROM base b JOIN common c USING (doc_id) GROUP BY doc_id),
    cd AS ({distance.format(h="chars", least=MIN_CHARS)}),
    wd AS ({distance.format(h="hist", least=MIN_WORDS)})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND coalesce(cd.dist, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(wd.dist, 0) <= {MAX_WORD_DISTANCE} AS kept
    FROM base LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)"""


ORACLE_SQL = _oracle()
