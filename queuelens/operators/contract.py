"""Document contract, table contract and the ingest circuit breaker."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import sqltext as q
from ..rules import DEFAULT_RULES, Rules
from ..schema import LEGACY_COLUMNS, REQUIRED_COLUMNS
from .prefixscan import in_pieces


class ContractError(ValueError):
    """A table or a run does not meet its contract."""


# --- tables ---------------------------------------------------------------------------

def missing_columns(df: DataFrame, required: Iterable[str] = REQUIRED_COLUMNS) -> list[str]:
    return sorted(set(required) - set(df.columns))


def legacy_columns(df: DataFrame, legacy: Iterable[str] = LEGACY_COLUMNS) -> list[str]:
    return sorted(set(legacy) & set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ContractError(f"columns missing from the request table: {missing}")
    return df


# --- documents ------------------------------------------------------------------------

# Fields of the document contract by kind of check.
WHOLE, NUMBER, TEXT = "whole", "number", "text"
ROOT_FIELDS = [("numeroCMCE", WHOLE, True), ("situacao", TEXT, True), ("dataSolicitacao", WHOLE, False)]
BLOCKS = {
    "usuarioSUS": [("nomeCompleto", TEXT, True), ("dataNascimento", WHOLE, False), ("cpf", TEXT, False)],
    "classificacaoRisco": [("cor", TEXT, False), ("pontosGravidade", NUMBER, False),
                           ("pontosTempo", NUMBER, False), ("totalPontos", NUMBER, False)],
}
EVENT_FIELDS = [("data", WHOLE, False), ("detalhes", TEXT, False)]


def _part(v: str, name: str) -> str:
    return f"try_variant_get({v}, '$.{name}', 'variant')"


def _facts(v: str, check: str = TEXT) -> str:
    """JSON type of a value and, for numbers, its text; no other check reads it."""
    kind = f"schema_of_variant({v}) AS kind"
    return f"struct({kind})" if check == TEXT else f"struct({kind}, try_variant_get({v}, '$', 'string') AS text)"


def _shape(fields: list) -> str:
    """Type that takes these fields out of an object in one pass over its keys; each path lookup would be a pass."""
    return f"STRUCT<{', '.join(f'{n}: VARIANT' for n, _, _ in fields)}>"


def _absent(fact: str) -> str:
    return f"coalesce({fact}.kind, 'VOID') = 'VOID'"


def _fits(fact: str, check: str) -> str:
    """Lax number rules: a boolean or a text that spells the number is accepted."""
    kind, text = f"{fact}.kind", f"{fact}.text"
    if check == TEXT:
        return f"{kind} = 'STRING'"
    numeric = f"({kind} IN ('BIGINT', 'BOOLEAN', 'DOUBLE', 'FLOAT') OR startswith({kind}, 'DECIMAL'))"
    if check == NUMBER:
        return f"({numeric} OR ({kind} = 'STRING' AND try_cast({text} AS DOUBLE) IS NOT NULL))"
    return (f"({kind} IN ('BIGINT', 'BOOLEAN') OR ({numeric} AND try_cast({text} AS DOUBLE) % 1 = 0) "
            rf"OR ({kind} = 'STRING' AND {q.strip(text)} RLIKE r'^[+-]?[0-9]+(\.0+)?$'))")


def _rule(fact: str, name: str, check: str, required: bool) -> str:
    missing = f"'{name}: missing'" if required else "NULL"
    return (f"CASE WHEN {_absent(fact)} THEN {missing} "
            f"WHEN NOT coalesce({_fits(fact, check)}, FALSE) THEN '{name}: wrong type' END")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once.

    A helper column would do the same, but a filter on the result is pushed through the
    projections below it, and every reference to a helper column would then be replaced by
    a copy of its expression.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def errors_expression(text: str, root: list = ROOT_FIELDS, blocks: dict = BLOCKS, event_fields: list = EVENT_FIELDS) -> str:
    """Contract violations of a JSON document, an empty array for a good one; by default of all fields of the contract.

    Types are checked on the parsed value itself, since a typed parse would turn a number
    into text silently. Unknown keys are fine, and a document may lack the history, but a
    history that is null is a violation. Null items and items that report a fetch error
    count as corrupt.
    """
    shape = [f"{n}: VARIANT" for n, _, _ in root] + [f"{b}: {_shape(fields)}" for b, fields in blocks.items()]
    shape += [f"evolucoes: ARRAY<{_shape(event_fields)}>", "error: VARIANT"]
    facts = [f"{_facts(f'p.{n}', check)} AS {n}" for n, check, _ in root]
    facts += [f"{_facts(f'p.{b}.{n}', check)} AS {b}_{n}" for b, fields in blocks.items() for n, check, _ in fields]
    # a block or a history of another type is null in ``p``; only then the value itself is looked at
    facts += [f"CASE WHEN p.{n} IS NULL THEN {_part('v', n)} END AS {n}" for n in [*blocks, "evolucoes"]]
    event_facts = "".join(f", {_facts(f'e.{n}', check)} AS {n}" for n, check, _ in event_fields)
    facts.append(f"transform(coalesce(p.evolucoes, array()), e -> struct(e IS NULL AS other{event_facts})) AS events")

    rules = [_rule(f"f.{n}", n, check, need) for n, check, need in root]
    for block, fields in blocks.items():
        rules.append(f"CASE WHEN f.{block} IS NOT NULL AND NOT is_variant_null(f.{block}) "
                     f"THEN '{block}: wrong type' END")
        rules += [f"CASE WHEN p.{block} IS NOT NULL "
                  f"THEN {_rule(f'f.{block}_{n}', f'{block}.{n}', check, need)} END"
                  for n, check, need in fields]
    rules.append("CASE WHEN f.evolucoes IS NOT NULL THEN if(is_variant_null(f.evolucoes), 'evolucoes: null', "
                 "'evolucoes: wrong type') END")
    event_rule = ", ".join(_rule(f"e.{n}", f"evolucoes.{n}", check, need)
                           for n, check, need in event_fields) or "CAST(NULL AS STRING)"
    event_rules = ("array_distinct(transform(f.events, e -> CASE WHEN e.other "
                   f"THEN 'evolucoes: wrong type' ELSE coalesce({event_rule}) END))")
    listed = f"array_compact(concat(array({', '.join(rules)}), {event_rules}))"
    checked = (f"CASE WHEN p.error IS NOT NULL THEN array('payload: corrupt') "
               f"ELSE {_let('f', 'struct(' + ', '.join(facts) + ')', listed)} END")
    return _let("v", f"try_parse_json({text})", f"""CASE
        WHEN v IS NULL OR is_variant_null(v) THEN array('payload: corrupt')
        WHEN NOT startswith(ltrim('{q.BLANKS}', {text}), '{{') THEN array('document: wrong type')
        ELSE {_let('p', f"try_variant_get(v, '$', 'STRUCT<{', '.join(shape)}>')", checked)} END""")


def with_errors(raw: DataFrame, text: str = "conteudo_json") -> DataFrame:
    return raw.selectExpr("*", f"{errors_expression(text)} AS errors")


def split_documents(raw: DataFrame, text: str = "conteudo_json") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters). Every row lands in exactly one of the two."""
    checked = with_errors(raw, text)
    good = checked.filter(F.size("errors") == 0).drop("errors")
    dead = checked.filter(F.size("errors") > 0).withColumnRenamed(text, "raw")
    return good, dead


# --- breaker --------------------------------------------------------------------------

def breaker_open(errors: int, total: int, rules: Rules = DEFAULT_RULES) -> bool:
    """Too many failures among enough rows; pass the totals of the run so far."""
    return total >= rules.breaker_min_rows and errors / total > rules.breaker_ratio


def running_breaker(rows: DataFrame, run: str = "run", seq: str = "seq", failed: str = "failed",
                    rules: Rules = DEFAULT_RULES, block: int = 1_000_000) -> DataFrame:
    """Running totals per run in ``seq`` order and the rows where the breaker would open.

    ``seq`` numbers the rows of a run without repeats, dense, sparse or in clusters. Runs of more than ``block`` rows
    are cut into pieces of that many rows by rank. Each piece is summed on its own; a window over the piece totals
    gives every piece its offset. No task sees a whole run.
    """
    cut = in_pieces(rows, [run], [seq], block)
    bad = F.coalesce(F.col(failed).cast("int"), F.lit(0))
    local = Window.partitionBy(run, "__piece").orderBy(seq).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = cut.withColumns({"__n": F.count(F.lit(1)).over(local), "__e": F.sum(bad).over(local)})
    earlier = Window.partitionBy(run).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(run, "__piece")
               .agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("e"))
               .select(run, "__piece",
                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n0"),
                       F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("__e0")))
    total, errors = F.col("__n") + F.col("__n0"), F.col("__e") + F.col("__e0")
    return (inside.join(offsets, [run, "__piece"])
            .withColumns({"total": total, "errors": errors,
                          "opens": (bad == 1) & (total >= rules.breaker_min_rows)
                          & (errors / total > rules.breaker_ratio)})
            .drop("__piece", "__n", "__e", "__n0", "__e0"))


def breaker_verdict(running: DataFrame, run: str = "run", seq: str = "seq") -> DataFrame:
    """First opening position and final counters per run."""
    return running.groupBy(run).agg(
        F.min(F.when(F.col("opens"), F.col(seq))).alias("opened_at"),
        F.max("total").alias("total"), F.max("errors").alias("errors"))
