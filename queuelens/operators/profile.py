"""Column profiles: frequencies, missing values, types and per-type statistics.

All columns are profiled in a few passes over (column, value) pairs. Result rows are one per
column, so frames named ``per column`` have as many rows as the schema has columns; only
such frames are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import day_first_timestamp, sql_round, strip
from .dedup import top_per_group
from .prefixscan import stored

# Name parts of sensitive and identifying columns.
SENSITIVE_HINTS = ["cpf", "nome", "mae", "cartao", "sus", "logradouro", "bairro", "cep",
                   "complemento", "numero", "nascimento", "quadro_clinico", "evolucao",
                   "historico"]
NUMERIC_ID_HINTS = ["id", "cpf", "cartao", "cep", "cmce"]
TEXT_ID_HINTS = ["cpf", "cartao", "numero", "id", "cmce", "cns", "cep"]

# Texts that stand for an empty value.
EMPTY_TEXTS = ["", " ", "nan", "none", "null", "na", "n/a", "não informado", "nao informado"]

# Fixed value: what a date inside a text looks like.
DATE_LIKE = r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{1,2}:\d{2}|T\d{2}:\d{2}"

#: Pieces of a quantile bracket that are ordered apart.
PIECES = 1000

NUMERIC, BOOLEAN, DATETIME, TEXT = "numeric", "boolean", "datetime", "text"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return TEXT


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def is_sensitive(name: str) -> bool:
    return any(hint in name.lower() for hint in SENSITIVE_HINTS)


# --- frequencies ------------------------------------------------------------------------

def as_pairs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One (column, value as text) row per cell; ``keep`` columns stay beside the pairs."""
    names = [c for c in df.columns if c not in keep]
    texts = df.select(*keep, *[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    return texts.unpivot([F.col(c) for c in keep], [F.col(f"`{c}`") for c in names], "column", "value")


def value_frequency(df: DataFrame) -> DataFrame:
    """Count of every value of every column, nulls included, in one job."""
    return as_pairs(df).groupBy("column", "value").agg(F.count(F.lit(1)).alias("Quantidade"))


def samples(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """First ``n`` values per column in the given row order, as a JSON list."""
    shadow = df.withColumns({f"__o{i}": F.col(c) for i, c in enumerate(order)})
    keys = [f"__o{i}" for i in range(len(order))]
    pairs = as_pairs(shadow, keys).filter("value IS NOT NULL")
    first = top_per_group(pairs, "column", [F.col(k) for k in keys], n)
    listed = F.array_sort(F.collect_list(F.struct(*keys, "value")))
    return first.groupBy("column").agg(
        F.to_json(F.transform(listed, lambda s: s["value"])).alias("amostra_valores"))


def frequent_values(df: DataFrame, n: int = 5, most: int = 10_000, head: int = 16) -> DataFrame:
    """(column, value, Quantidade) of the ``n`` most frequent values per column, ties by value.

    Values are counted by 128 bits of hashes beside the first ``head`` characters, so that what is shuffled does not
    depend on the texts' lengths. The n-th row of a column by count and head cuts it to its contenders; only their texts
    are fetched. If more than ``most`` (or twice what is asked for) tie with the n-th, the head is made longer: heads that
    hold whole values leave no tie.
    """
    cells = as_pairs(df).filter("value IS NOT NULL").select(
        "column", "value", F.xxhash64("value").alias("a"), F.xxhash64("value", F.lit(1)).alias("b"))
    bound = max(most, 2 * n * len(df.columns))
    while True:
        counted = stored(cells.groupBy("column", "a", "b", F.substring("value", 1, head).alias("head")).agg(
            F.count(F.lit(1)).alias("Quantidade")), "value-hashes")
        best = Window.partitionBy("column").orderBy(F.desc("Quantidade"), "head")
        cuts = (counted.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)
                .groupBy("column").agg(F.max_by(F.struct("Quantidade", "head"), "place").alias("cut")))
        q, cut = F.col("Quantidade"), F.col("cut")
        met = counted.join(F.broadcast(cuts), "column").filter(  # one row per column
            (q > cut["Quantidade"]) | ((q == cut["Quantidade"]) & (F.col("head") <= cut["head"])))
        contenders = stored(met.select("column", "a", "b"), "frequent-hashes")
        if contenders.count() <= bound:
            break
        head *= 8
    texts = (cells.join(F.broadcast(contenders), ["column", "a", "b"])  # at most ``bound`` rows
             .groupBy("column", "value").agg(F.count(F.lit(1)).alias("Quantidade")))
    return top_per_group(texts, "column", [F.desc("Quantidade"), F.col("value")], n)


def top_values(frequencies: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent values per column as JSON, with the mode and its count; ties by value."""
    top = top_per_group(frequencies.filter("value IS NOT NULL"), "column",
                        [F.desc("Quantidade"), F.col("value")], n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("Quantidade")).alias("k"), F.col("value"))))
    listed = top.groupBy("column").agg(ordered.alias("top"))
    return listed.select(
        "column", F.to_json(F.transform("top", lambda t: F.struct(
            t["value"].alias("valor"), (-t["k"]).alias("freq")))).alias("top_5_valores"),
        F.col("top")[0]["value"].alias("valor_mais_frequente"),
        (-F.col("top")[0]["k"]).alias("freq_valor_mais_frequente"))


def cardinality_class(unique: Column, total: Column) -> Column:
    share = unique / F.when(total > 0, total)
    return (F.when(total == 0, "indefinida").when(unique == 0, "sem valores").when(unique == 1, "constante")
            .when(share >= 0.95, "quase unica").when(share >= 0.50, "alta").when(share >= 0.05, "media")
            .otherwise("baixa"))


def counts(df: DataFrame) -> DataFrame:
    """Rows, missing, distinct and empty-like counts with their shares, per column.

    Values are told apart by 128 bits of hashes, so that the shuffle carries those and not
    the values; all missing cells of a map task are one row.
    """
    cells = as_pairs(df).select(
        "column", F.col("value").isNull().alias("missing"), F.xxhash64("value").alias("a"),
        F.xxhash64("value", F.lit(1)).alias("b"), F.coalesce(F.lower(strip(F.col("value"))).isin(EMPTY_TEXTS), F.lit(False)).alias("empty"))
    n = F.col("n")
    base = cells.groupBy("column", "missing", "a", "b", "empty").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(
        F.sum(n).alias("total_linhas"), F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("nulos"),
        F.count_if(~F.col("missing")).alias("n_unicos"), F.sum(F.when(F.col("empty"), n).otherwise(0)).alias("vazios_textuais"))
    total = F.col("total_linhas")

    def share(c: str) -> Column:
        return sql_round(F.col(c) / total * 100, 4)

    return base.withColumns({"pct_nulos": share("nulos"), "pct_unicos": share("n_unicos"),
                             "pct_vazios_textuais": share("vazios_textuais"),
                             "cardinalidade": cardinality_class(F.col("n_unicos"), total)})


# --- exact quantiles --------------------------------------------------------------------

def exact_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float],
                    accuracy: int = 10000) -> DataFrame:
    """Exact interpolated quantiles ``q0 .. qn`` per group without sorting everything.

    A sketch gives a narrow bracket around every wanted rank. One aggregation then keeps
    single values only inside the brackets and one counter (with its smallest and largest
    value) for each gap between them; ranks are read off the running counts of those few
    cells, which are summed up in pieces of a bracket, so that no task orders all of them. A rank that fell inside a gap would raise an error, never give a wrong figure.
    The bracket frame has one row per group. It is stored, so that Spark's own size check knows its size: a small one is
    broadcast and the rows stay where they are, instead of meeting in one task per group.
    """
    v, slack = F.col(value), 2.0 / accuracy
    rows = df.filter(v.isNotNull()).select(group, v.cast("double").alias("v"))
    low = [max(p - slack, 0.0) for p in probs]
    high = [min(p + slack, 1.0) for p in probs]
    brackets = stored(rows.groupBy(group).agg(
        F.percentile_approx("v", low, accuracy).alias("low"),
        F.percentile_approx("v", high, accuracy).alias("high")), "brackets")
    # spelled out per probability, so that both stay inside generated code
    gap = " + ".join(f"if(v > high[{i}], 1, 0)" for i in range(len(probs)))
    inside = " OR ".join(f"(v >= low[{i}] AND v <= high[{i}])" for i in range(len(probs)))
    # pieces of a bracket, in the order of their values; a bracket without width is one piece
    piece = f"if(inside, least({PIECES - 1}, floor((v - low[gap]) / nullif(high[gap] - low[gap], 0) * {PIECES})), 0)"
    tagged = rows.join(brackets, group).selectExpr("*", f"{gap} AS gap", f"{inside} AS inside").selectExpr(
        group, "v", "gap", "inside", f"coalesce({piece}, 0) AS piece")
    keys = [group, "gap", "inside", "piece"]
    cells = stored(tagged.groupBy(*keys, F.when(F.col("inside"), F.col("v")).alias("point")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last")), "quantile-cells")  # read twice
    before = Window.partitionBy(group).orderBy("gap", "inside", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy(*keys).agg(F.sum("n").alias("held")).select(
        *keys, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"),
        F.sum("held").over(Window.partitionBy(group)).alias("total"))
    local = Window.partitionBy(*keys).orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("here", F.sum("n").over(local)).join(offsets, keys).withColumn(
        "end", F.col("here") + F.col("offset"))
    start, end = F.col("end") - F.col("n"), F.col("end")

    def at(rank: Column) -> Column:
        here = (start <= rank) & (rank < end)
        found = (F.when(F.col("first") == F.col("last"), F.col("first"))
                 .when(rank == start, F.col("first")).when(rank == end - 1, F.col("last"))
                 .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")))
        return F.max(F.when(here, found))

    figures = []
    for i, p in enumerate(probs):
        position = (F.col("total") - 1) * F.lit(float(p))
        below, above = at(F.floor(position)), at(F.ceil(position))
        figures.append((below + (above - below) * F.max(position - F.floor(position))).alias(f"q{i}"))
    return ranked.groupBy(group).agg(*figures)


# --- statistics per kind ------------------------------------------------------------------

def numeric_pairs(df: DataFrame) -> DataFrame:
    names = columns_of(df, NUMERIC)
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(
        [], [F.col(f"`{c}`") for c in names], "column", "value")


def numeric_stats(df: DataFrame) -> DataFrame:
    """Extremes, quartiles, mean, deviation, zeros, negatives and 1.5 x IQR outliers."""
    pairs = numeric_pairs(df)
    v = F.col("value")
    quartiles = exact_quantiles(pairs, "column", "value", [0.25, 0.5, 0.75])
    iqr = F.col("q2") - F.col("q0")
    fences = quartiles.withColumns({"iqr": iqr, "lo": F.col("q0") - 1.5 * iqr, "hi": F.col("q2") + 1.5 * iqr})
    stats = pairs.join(F.broadcast(fences), "column", "left").groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.min(v).alias("num_min"), F.max("q0").alias("num_p25"),
        F.max("q1").alias("num_mediana"), F.avg(v).alias("num_media"), F.max("q2").alias("num_p75"),
        F.max(v).alias("num_max"), F.stddev_samp(v).alias("num_std"), F.count_if(v == 0).alias("num_zeros"),
        F.count_if(v < 0).alias("num_negativos"), F.max("iqr").alias("num_iqr"),
        F.count_if((v < F.col("lo")) | (v > F.col("hi"))).alias("num_outliers_iqr"))
    return stats.withColumns({f"num_pct_{c}": F.col(f"num_{c}") / F.col("rows") * 100
                              for c in ["zeros", "negativos", "outliers_iqr"]}).drop("rows")


def datetime_stats(df: DataFrame, as_of, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last time, span in full days, future dates and dates before 2000."""
    names = columns_of(df, DATETIME) if columns is None else list(columns)
    times = df.select(*[day_first_timestamp(F.col(f"`{c}`").cast("string")).alias(c) for c in names]).unpivot(
        [], [F.col(f"`{c}`") for c in names], "column", "value")
    v = F.col("value")
    base = times.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.min(v).alias("data_min"), F.max(v).alias("data_max"),
        F.count_if(v > F.lit(str(as_of)).cast("timestamp")).alias("data_futuras"),
        F.count_if(v < F.lit("2000-01-01").cast("timestamp")).alias("data_antes_2000"))
    span = F.floor((F.unix_millis("data_max") - F.unix_millis("data_min")) / 86400000.0)
    return base.withColumns({
        "data_amplitude_dias": span, "data_pct_futuras": F.col("data_futuras") / F.col("rows") * 100,
        "data_pct_antes_2000": F.col("data_antes_2000") / F.col("rows") * 100}).drop("rows")


def boolean_stats(df: DataFrame) -> DataFrame:
    names = columns_of(df, BOOLEAN)
    flags = df.select(*[F.col(f"`{c}`") for c in names]).unpivot(
        [], [F.col(f"`{c}`") for c in names], "column", "value")
    base = flags.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count_if("value").alias("bool_true"),
                                       F.count_if(~F.col("value")).alias("bool_false"))
    return base.withColumns({f"bool_pct_{c}": F.col(f"bool_{c}") / F.col("rows") * 100
                             for c in ["true", "false"]}).drop("rows")


def text_stats(df: DataFrame) -> DataFrame:
    """Shortest, mean, median and longest text, from a histogram of lengths; no text is shuffled."""
    names = columns_of(df, TEXT)
    lengths = (df.select(*[F.length(f"`{c}`").alias(c) for c in names])
               .unpivot([], [F.col(f"`{c}`") for c in names], "column", "len").filter("len IS NOT NULL")
               .groupBy("column", "len").agg(F.count(F.lit(1)).alias("n")))
    return lengths.groupBy("column").agg(
        F.min("len").alias("txt_len_min"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("txt_len_media"),
        F.percentile("len", 0.5, F.col("n")).alias("txt_len_mediana"), F.max("len").alias("txt_len_max"))


def date_like(df: DataFrame) -> DataFrame:
    """Share of date-looking and of parsable texts among all values of the text columns.

    One aggregation without any shuffle of values. The cheap pattern decides whether the
    parse share counts at all.
    """
    names = columns_of(df, TEXT)

    def shares(c: str) -> list[Column]:
        v = F.col(f"`{c}`")
        return [F.count(v), F.count_if(v.rlike(DATE_LIKE)), F.count_if(day_first_timestamp(v).isNotNull())]

    one = df.agg(*[x.alias(f"{c}/{k}") for c in names for k, x in enumerate(shares(c))])
    rows = one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), *[F.col(f"`{c}/{k}`").alias(name) for k, name in enumerate(("n", "like", "parsed"))])
        for c in names]))).filter("n > 0")
    ratio = F.when(F.col("like") / F.col("n") >= 0.4, F.col("parsed") / F.col("n")).otherwise(0.0)
    return rows.select("column", ratio.alias("parsed_ratio"), (ratio >= 0.8).alias("is_date_like"))


# --- whole profile ------------------------------------------------------------------------

def _metadata(df: DataFrame) -> DataFrame:
    """Per column: type, kind and what its name hints at."""
    rows = []
    for f in df.schema.fields:
        name, kind = f.name.lower(), kind_of(f.dataType)
        hints = NUMERIC_ID_HINTS if kind == NUMERIC else TEXT_ID_HINTS
        rows.append((f.name, f.dataType.simpleString(), kind, isinstance(f.dataType, T.IntegralType),
                     any(h in name for h in hints), is_sensitive(f.name)))
    return df.sparkSession.createDataFrame(
        rows, "column STRING, dtype STRING, kind STRING, is_integer BOOLEAN, id_hint BOOLEAN, sensivel BOOLEAN")


def analytical_type() -> Column:
    kind, unique, share = F.col("kind"), F.col("n_unicos"), F.col("n_unicos") / F.col("total_linhas")
    length = F.coalesce("txt_len_media", F.lit(0.0))
    return (F.when(kind == DATETIME, "data_hora").when(kind == BOOLEAN, "booleana")
            .when(F.col("id_hint"), "identificador_potencial")
            .when((kind == NUMERIC) & (unique <= 2), "booleana_codificada")
            .when((kind == NUMERIC) & F.col("is_integer"), "numerica_discreta")
            .when(kind == NUMERIC, "numerica_continua")
            .when(unique <= 2, "booleana_textual")
            .when(F.coalesce("is_date_like", F.lit(False)), "data_hora_texto")
            .when((share >= 0.90) & (length > 30), "texto_livre").when(share >= 0.90, "alta_cardinalidade")
            .when(length > 40, "texto_livre").otherwise("categorica"))


def observations() -> Column:
    total, missing = F.col("total_linhas"), F.col("nulos") / F.col("total_linhas")
    kind, share = F.col("tipo_inferido"), F.col("n_unicos") / F.col("total_linhas")
    dominance = F.when(kind.isin("categorica", "booleana_textual", "booleana"),
                       F.col("freq_valor_mais_frequente") / total)
    parsed = F.col("parsed_ratio")
    return F.concat_ws(
        "; ", F.when(F.col("nulos") == total, "100% nula"),
        F.when(missing >= 0.90, "muitos nulos (>90%)").when(missing >= 0.50, "muitos nulos (>50%)"),
        F.when(F.col("n_unicos") == 1, "coluna constante"), F.when(share >= 0.95, "alta unicidade"),
        F.when(kind == "identificador_potencial", "possivel identificador"),
        F.when(kind == "texto_livre", "possivel texto livre"),
        F.when(dominance >= 0.95, "categoria dominante >95%").when(dominance >= 0.80, "categoria dominante >80%"),
        F.when(F.col("sensivel"), "campo sensivel"),
        F.when((parsed > 0.0) & (parsed < 0.8), "texto com parte convertivel para data"))


def profile(df: DataFrame, order: Sequence[str], as_of, frequencies: DataFrame | None = None) -> DataFrame:
    """One row per column with all figures. ``order`` gives the source order for samples.

    Frequencies serve the most frequent values only; pass a frame of them (``value_frequency``) if there is one already.
    """
    freq = frequent_values(df) if frequencies is None else frequencies
    parts = [counts(df), top_values(freq), samples(df, order)]
    if columns_of(df, TEXT):
        parts += [text_stats(df), date_like(df)]
    if columns_of(df, NUMERIC):
        parts.append(numeric_stats(df))
    if columns_of(df, DATETIME):
        parts.append(datetime_stats(df, as_of))
    if columns_of(df, BOOLEAN):
        parts.append(boolean_stats(df))
    whole = _metadata(df)
    for part in parts:
        whole = whole.join(part, "column", "left")
    for name in ["txt_len_media", "parsed_ratio"]:
        whole = whole if name in whole.columns else whole.withColumn(name, F.lit(None).cast("double"))
    if "is_date_like" not in whole.columns:
        whole = whole.withColumn("is_date_like", F.lit(False))
    text_only = {c: F.when(F.col("kind") == TEXT, F.col(c)) for c in ["vazios_textuais", "pct_vazios_textuais"]}
    done = (whole.withColumns(text_only).withColumn("tipo_inferido", analytical_type())
            .withColumn("observacoes", observations()).drop("kind", "is_integer", "id_hint", "is_date_like")
            .withColumnRenamed("column", "coluna"))
    return done.orderBy(F.col("tipo_inferido").asc(), F.col("pct_nulos").desc(), F.col("pct_unicos").desc())


def type_summary(profile_df: DataFrame) -> DataFrame:
    """Columns per analytical type with mean missing and mean distinct shares."""
    return profile_df.groupBy("tipo_inferido").agg(
        F.count("coluna").alias("qtd_colunas"), F.avg("pct_nulos").alias("media_pct_nulos"),
        F.avg("pct_unicos").alias("media_pct_unicos")).orderBy(F.desc("qtd_colunas"), "tipo_inferido")
