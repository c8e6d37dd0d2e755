"""Summary payloads: JSON to structs with defaults and back; outcomes of validation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EXIT_REASONS, INTERNAL_EXITS

_ALLOCATION = "struct<type:string,source:string,size_expr:string,size_params:array<string>,returned:boolean,stored_to:string,may_be_null:boolean>"
_FREE = "struct<target:string,target_kind:string,deallocator:string,conditional:boolean,nulled_after:boolean,condition:string,description:string>"
_INIT = "struct<target:string,target_kind:string,initializer:string,byte_count:string,conditional:boolean,condition:string>"
_CONTRACT = "struct<target:string,contract_kind:string,description:string,size_expr:string,relationship:string,condition:string>"
_ISSUE = "struct<location:string,issue_kind:string,description:string,severity:string,callee:string,contract_kind:string>"
#: Payload of each pass.
PAYLOADS = {
    "allocation": f"function string, allocations array<{_ALLOCATION}>, parameters map<string,struct<role:string,used_in_allocation:boolean>>, buffer_size_pairs array<struct<buffer:string,size:string,kind:string,relationship:string>>, description string",
    "free": f"function string, frees array<{_FREE}>, resource_releases array<{_FREE}>, description string",
    "init": f"function string, inits array<{_INIT}>, output_ranges array<struct<target:string,range:string,description:string>>, noreturn boolean, noreturn_condition string, description string",
    "memsafe": f"function string, contracts array<{_CONTRACT}>, description string",
    "verify": f"function string, simplified_contracts array<{_CONTRACT}>, issues array<{_ISSUE}>, description string",
    "leak": f"function string, simplified_allocations array<{_ALLOCATION}>, simplified_frees array<{_FREE}>, issues array<{_ISSUE}>, description string",
    "overflow": f"function string, issues array<{_ISSUE}>, output_ranges array<struct<target:string,range:string,description:string>>, constraints array<struct<target:string,range:string,description:string>>, description string",
}
#: Arrays that stay null where absent: null means unknown there, empty means none.
NULLABLE = {"simplified_contracts", "simplified_allocations", "simplified_frees"}
SEVERITIES = ("high", "medium", "low")
ALLOCATION_TYPES = ("heap", "stack", "static", "escaped_stack", "unknown")
CONTRACT_KINDS = ("not_null", "not_freed", "initialized", "buffer_size", "disjoint")


def decoded(json: Column, kind: str) -> Column:
    """Struct of a payload, with defaults: empty arrays, maps and texts, false flags."""
    parsed = F.from_json(json, PAYLOADS[kind])
    fields = []
    for part in _fields(PAYLOADS[kind]):
        name, _, type_ = part.partition(" ")
        c = parsed[name]
        if type_.startswith("array") and name not in NULLABLE:
            c = F.coalesce(c, F.array().cast(type_))
        elif type_.startswith("map"):
            c = F.coalesce(c, F.from_json(F.lit("{}"), type_))
        elif type_ == "boolean":
            c = F.coalesce(c, F.lit(False))
        elif type_ == "string" and name in ("function", "description"):
            c = F.coalesce(c, F.lit(""))
        fields.append(c.alias(name))
    return F.struct(*fields)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def encoded(payload: Column, nulls: bool = False) -> Column:
    """JSON of a payload; optional fields are left out unless nulls."""
    return F.to_json(payload, {"ignoreNullFields": "false" if nulls else "true"})


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """A value of an enumeration; anything else is the default."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(*allowed), low).otherwise(F.lit(default))


def checked_contracts(contracts: Column) -> Column:
    """Contracts with a known kind, a size for buffers only."""
    kind = lambda c: one_of(c["contract_kind"], CONTRACT_KINDS, "not_null")
    return F.transform(contracts, lambda c: F.struct(c["target"].alias("target"), kind(c).alias("contract_kind"), F.coalesce(c["description"], F.lit("")).alias("description"), F.when(kind(c) == "buffer_size", c["size_expr"]).alias("size_expr"), F.when(kind(c) == "buffer_size", c["relationship"]).alias("relationship"), c["condition"].alias("condition")))


def checked_issues(issues: Column) -> Column:
    return F.transform(issues, lambda i: i.withField("severity", one_of(i["severity"], SEVERITIES, "medium")))


def parsed_or(text: Column, schema: str, default: str) -> Column:
    """A response as a struct; the default document where it doesn't parse."""
    ok = F.try_parse_json(text).isNotNull()
    return F.from_json(F.when(ok, text).otherwise(F.lit(default)), schema)


def changed_flag(json: Column) -> Column:
    """Whether a member of a recursive component says that it changed; yes if it says nothing."""
    return F.coalesce(F.get_json_object(json, "$.changed").try_cast("boolean"), F.lit(True))


_RUN = "struct<crashes:array<string>,assertions:struct<assertions:array<struct<assertion_id:string,types:array<string>,fail_count:int,pass_count:int>>>,plan_coverage:struct<traces:array<struct<status:string>>>>"


def crash_kinds(crashes: Column) -> Column:
    """Reasons of real crashes: given ones stay, bare codes get their reason, internal codes aren't crashes."""
    code = lambda c: c.try_cast("int")
    names = F.create_map(*(x for k, v in EXIT_REASONS.items() for x in (F.lit(k), F.lit(v))))
    named = lambda c: F.coalesce(F.get_json_object(c, "$.reason"), F.try_element_at(names, code(c)), F.concat(F.lit("unknown("), c, F.lit(")")))
    real = F.filter(F.coalesce(crashes, F.array().cast("array<string>")), lambda c: ~F.coalesce(code(c).isin(*INTERNAL_EXITS), F.lit(False)))
    return F.transform(real, named)


def outcome(hypothesis: Column, run: Column) -> Column:
    """struct(outcome, confirmed, crashes, failures, covered, infeasible, missed) of one verdict's run (JSON)."""
    got = F.from_json(run, _RUN)
    crashes = crash_kinds(got["crashes"])
    none = F.array().cast("array<struct<assertion_id:string,types:array<string>,fail_count:int,pass_count:int>>")
    failures = F.filter(F.coalesce(got["assertions"]["assertions"], none), lambda a: F.coalesce(a["fail_count"], F.lit(0)) > 0)
    states = F.transform(F.coalesce(got["plan_coverage"]["traces"], F.array().cast("array<struct<status:string>>")), lambda t: F.coalesce(t["status"], F.lit("")))
    covered, infeasible = F.size(F.filter(states, lambda s: s == "covered")), F.size(F.filter(states, lambda s: s == "infeasible"))
    evidence = (F.size(crashes) > 0) | (F.size(failures) > 0)
    said = F.coalesce(hypothesis, F.lit("unknown"))
    confirmed = F.when(said == "safe", ~evidence).when(said == "feasible", evidence | (covered > 0)).otherwise(F.lit(False))
    word = F.when(said.isin("safe", "feasible"), F.concat(said, F.when(confirmed, F.lit("_confirmed")).otherwise(F.lit("_rejected")))).otherwise(F.lit("unknown"))
    return F.struct(word.alias("outcome"), confirmed.alias("confirmed"), F.size(crashes).alias("crashes"), F.size(failures).alias("failures"), covered.alias("covered"), infeasible.alias("infeasible"), (F.size(states) - covered - infeasible).alias("missed"))


def merged_view(functions: DataFrame, summaries: dict[str, DataFrame]) -> DataFrame:
    """One row per function: name and the JSON of each pass, null where there is none."""
    out = functions.select("id", "name")
    for name, df in summaries.items():
        out = out.join(df.select(F.col("function_id").alias("id"), F.col("summary_json").alias(name)), "id", "left")
    return out
