"""Gated three-state decisions. A gate that wasn't assessed never counts as passed: comparisons with null are false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DecisionSettings
from ..functions.sequence import col

PATHOGENIC, INCONCLUSIVE, NEGATIVE, NO_CALL = "PATHOGENIC", "INCONCLUSIVE", "NO_PATHOGENIC_VARIANT_DETECTED", "NO_CALL"


def true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(true(c), t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]))


def supported(m: Column) -> Column:
    """A frameshift with an exact template and either an exact edit or enough reads."""
    return true(m["frameshift"]) & true(m["template_match"]) & (true(m["support_status"] == "exact") | true(m["read_support_status"] == "supported"))


def blockers(m: Column, depth_status: Column, legacy_low: Column) -> Column:
    """Why a mutation doesn't decide by itself, in order."""
    support = true(m["support_status"] == "exact") | true(m["read_support_status"] == "supported")
    return reasons(
        (~true(m["frameshift"]), "not a frameshift"),
        (~true(m["template_match"]), "no exact template"),
        (true(m["ambiguous_place"]), "ambiguous localisation"),
        (~support, "not supported by reads or edits"),
        (depth_status.isNotNull() & ~true(depth_status == "adequate"), "low carrier depth"),
        (depth_status.isNull() & true(legacy_low), "low coverage"),
    )


def depth_gate(depth_status, assessed) -> Column:
    """Fail-closed: where depth was assessed, anything but adequate fails."""
    s = col(depth_status)
    return F.when(col(assessed) & ~true(s == "adequate"), F.concat(F.lit("depth "), F.coalesce(s, F.lit("not assessed"))))


def allele_reasons(a: Column, label: Column, assessed: Column) -> Column:
    """What speaks against a negative call on one allele."""
    say = lambda text: F.concat(label, F.lit(": " + text))
    gate = depth_gate(a["depth_status"], assessed)
    return reasons(
        (gate.isNotNull(), F.concat(label, F.lit(": "), gate)),
        (true(a["selection_status"].startswith("unresolved")), say("unresolved selection")),
        (true(a["residual_sites"] > 0), say("residual heterozygous sites")),
        (true(a["unassessed_run_sites"] > 0), say("run-length sites not excluded")),
        (true(a["stage_discordant"]), say("calls disagree between stages")),
    )


def decide(samples: DataFrame, s: DecisionSettings = DecisionSettings()) -> DataFrame:
    """Adds decision, reasons, caveats. samples: alleles, mutations (arrays of structs), execution_ok, total_reads, ambiguous_bases.

    A mutation struct has blockers; an allele struct has reasons. An unblocked mutation is positive whatever the gates say,
    which then are caveats; otherwise any gate makes the sample inconclusive.
    """
    m, a = F.col("mutations"), F.col("alleles")
    free = F.exists(m, lambda x: F.size(x["blockers"]) == 0)
    assessed = F.exists(a, lambda x: x["depth_status"].isNotNull())
    gates = F.concat(
        reasons(
            (~true(assessed) & ~true(F.col("total_reads") >= s.legacy_reads), "low coverage"),
            (F.col("ambiguous_bases") > s.ambiguous_bases, "ambiguous bases"),
            (~true(F.col("execution_ok")), "execution warning"),
        ),
        F.transform(F.filter(m, lambda x: F.size(x["blockers"]) > 0), lambda x: F.concat(x["name"], F.lit(" is inconclusive ("), F.array_join(x["blockers"], "; "), F.lit(")"))),
        F.flatten(F.transform(a, lambda x: x["reasons"])),
    )
    state = F.when(m.isNull() | a.isNull(), NO_CALL).when(free, PATHOGENIC).when(F.size("_gates") > 0, INCONCLUSIVE).otherwise(NEGATIVE)
    out = samples.withColumn("_gates", gates).withColumn("decision", state)
    none = F.array().cast("array<string>")
    positive = F.col("decision") == PATHOGENIC
    return out.withColumn("reasons", F.when(positive, none).otherwise(F.col("_gates"))).withColumn("caveats", F.when(positive, F.col("_gates")).otherwise(none)).drop("_gates")


def stored_decision(summary) -> Column:
    """The decision of a stored JSON summary; unreadable or absent is NO_CALL."""
    return F.coalesce(F.get_json_object(col(summary), "$.clinical.decision"), F.lit(NO_CALL))


def truth_class(events: DataFrame) -> DataFrame:
    """normal (no event), pathogenic (a net frameshift) or benign; events(sample, net_bp), null net_bp: none."""
    shift = F.max(F.when(F.pmod("net_bp", F.lit(3)) != 0, 1).otherwise(0))
    return events.groupBy("sample").agg(F.when(F.count("net_bp") == 0, "normal").when(shift == 1, "pathogenic").otherwise("benign").alias("truth"))
