"""Findings about package references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.names import registry_name, registry_site
from tessel.functions.risk import is_stacked, with_risk
from tessel.sources.registry import age_days

CWE = "CWE-1357"
FINDING = ["scan_id", "rank", "ord", "type", "severity", "title", "description", "file", "line", "recommendation", "cve"]


def ghost_can_block(source: Column, ecosystem: Column, pkg: Column, speaks: Column) -> Column:
    """Whether a name that the registry doesn't have may block.

    A declared dependency may.  Outside npm an imported name needn't be the package's.  An npm name without a
    scope may; one with a scope only if the scan has evidence about that scope.
    """
    return F.when(source == "manifest", True).when(ecosystem != "npm", False).when(~pkg.startswith("@"), True).otherwise(speaks)


def known_state(exists: Column, unreachable: Column, tier: Column, recorded: Column, published_day: Column) -> Column:
    """Of a listed name: registered (after it was listed), there, unknown or absent.

    The day that anybody could have reported (tier community) supports no accusation.
    """
    there = exists & ~unreachable
    after = F.coalesce(published_day > recorded, F.lit(False)) & (tier != "community")
    return F.when(there & after, "registered").when(there, "there").when(unreachable, "unknown").otherwise("absent")


def state_severity(state: Column) -> Column:
    return F.when(state.isin("registered", "absent"), "critical").otherwise("warning")


def provenance(tier: Column) -> Column:
    """How a name came to be listed, in words that its tier supports."""
    return (
        F.when(tier == "reported", "research outside reports that assistants suggest it").when(tier == "observed", "an assistant was seen to suggest it")
        .when(tier == "community", "a user reported it when the registry didn't have it").otherwise("it was built from a pattern of invented names; nobody has reported it")
    )


def manifest_errors(errors: DataFrame) -> DataFrame:
    """A warning for each manifest that can't be read: its dependencies are not verified."""
    path = F.col("path")
    return errors.select(
        "scan_id", F.lit(0).alias("rank"), F.col("file_ord").cast("long").alias("ord"), F.lit("manifest_unparsable").alias("type"), F.lit("warning").alias("severity"), F.concat(path, F.lit(" can't be parsed")).alias("title"),
        F.concat(F.lit("Its dependencies were not verified: "), path, F.lit(" is not valid JSON.")).alias("description"), path.alias("file"), F.lit(1).alias("line"), F.lit("Mend the manifest and check again.").alias("recommendation"), F.lit(None).cast("string").alias("cve"),
    )


def package_findings(refs: DataFrame, as_of: str) -> DataFrame:
    """Findings for references with their registry's result, list entry, budget and evidence.

    A listed name has that finding alone; otherwise the registry was not reached, doesn't have the name, or has
    it new.  A reference over the budget counts as not reached, listed or not.  A package that is there can
    have a stacked risk besides.
    """
    state = known_state(F.col("exists"), F.col("unreachable"), F.col("tier"), F.col("recorded"), F.col("_day"))
    refs = refs.withColumns({"_name": registry_name(F.col("ecosystem")), "_day": F.date_format("published_at", "yyyy-MM-dd"), "_days": age_days(F.col("published_at"), as_of), "_over": ~F.col("looked_up")})
    refs = refs.withColumns({"_state": state, "_block": ghost_can_block(F.col("source"), F.col("ecosystem"), F.col("pkg"), F.col("speaks"))})
    signals = {"exists": F.col("exists"), "unreachable": F.col("unreachable"), "is_new": F.col("is_new"), "age_days": F.col("_days")} | {c: F.col(c) for c in ("has_repository", "has_provenance", "has_install_scripts", "is_deprecated")}
    refs = with_risk(refs, signals, "_risk")
    refs = refs.withColumns({"_quoted": F.concat(F.lit('"'), F.col("pkg"), F.lit('"')), "_at": F.concat(F.lit(" Found in "), F.col("path"), F.lit(", line "), F.col("line").cast("string"), F.lit(".")), "_look": F.concat(F.lit("Check the name on "), registry_site(F.col("ecosystem")), F.lit("."))})
    eco, name, quoted, at, look = F.col("ecosystem"), F.col("_name"), F.col("_quoted"), F.col("_at"), F.col("_look")
    over, unreachable, day, days, state, block = (F.col(c) for c in ("_over", "unreachable", "_day", "_days", "_state", "_block"))
    listed = F.col("tier").isNotNull() & ~over
    ago = F.when(days.isNull(), F.lit("recently")).otherwise(F.concat(days.cast("string"), F.when(days == 1, F.lit(" day ago")).otherwise(F.lit(" days ago"))))

    def finding(kind: str, severity: Column, title: Column, text: Column, advice: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), severity.alias("severity"), title.alias("title"), F.concat(text, at).alias("description"), advice.alias("recommendation"))

    warning = F.lit("warning")
    known = finding(
        "known_hallucination", state_severity(state),
        F.when(state == "registered", F.concat(quoted, F.lit(" is a listed invented name and has been registered since"))).when(state == "there", F.concat(quoted, F.lit(" is a listed invented name that a real package has too")))
        .when(state == "unknown", F.concat(quoted, F.lit(" is a listed invented name; "), name, F.lit(" was not reached"))).otherwise(F.concat(quoted, F.lit(" is a listed invented name and does not exist"))),
        F.concat(F.lit("Listed because "), provenance(F.col("tier")), F.coalesce(F.concat(F.lit(" (recorded "), F.col("recorded"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit("; first published "), F.when(~unreachable & F.col("exists"), day)), F.lit("")), F.lit(".")),
        F.when(state == "registered", F.lit("Don't install it; find the package that was meant.")).when(state == "absent", F.lit("Remove the reference; find the package that was meant.")).otherwise(look),
    )
    unverified = finding("registry_unreachable", warning, F.concat(quoted, F.lit(" could not be verified: "), name, F.lit(" was not reached")), F.lit("Whether the package exists is unknown; this is no clean result."), F.concat(F.lit("Check again later. "), look))
    gap = (F.col("source") == "import") & (eco != "npm")
    ghost = finding(
        "ghost_package", F.when(block, F.lit("critical")).otherwise(warning), F.when(gap, F.concat(F.lit("The imported name "), quoted, F.lit(" is no package of "), name)).otherwise(F.concat(quoted, F.lit(" does not exist on "), name)),
        F.when(gap, F.lit("An import's name and its package's often differ; the manifest settles it.")).when(F.col("source") == "manifest", F.lit("It is declared as a dependency and the registry doesn't have it."))
        .when(block, F.lit("It is imported and the registry doesn't have it.")).otherwise(F.lit("It is imported and the registry doesn't have it; nothing in the scan tells whether its scope is the project's own.")),
        F.concat(F.lit("Remove the reference, don't install it. "), look),
    )
    new = finding("new_package_risk", warning, F.concat(quoted, F.lit(" was first published "), ago), F.lit("Invented names get registered and then installed."), F.lit("Make sure that the publisher and the package are the ones meant."))
    main = (
        F.when(over, unverified).when(listed, known).when(unreachable, unverified).when(~F.col("exists"), ghost).when(F.col("is_new"), new)
    )
    shape = F.col("_risk")
    notes = F.array_join(F.transform(F.filter(shape["factors"], lambda x: x["points"] > 0), lambda x: x["note"]), " ")
    stacked = finding("dependency_risk_shape", warning, F.concat(quoted, F.lit(" has several risks at once ("), shape["score"].cast("string"), F.lit("/100)")), F.concat(notes, F.lit(" An estimate from metadata.")), F.lit("Review it before trusting it."))
    more = F.when(~over & ~listed & F.col("exists") & ~unreachable & is_stacked(shape), stacked)
    each = refs.select("scan_id", "ord", "path", "line", "_over", F.posexplode(F.filter(F.array(main, more), lambda x: x.isNotNull())).alias("_k", "_f"))
    # those over the budget come after all others
    return each.select("scan_id", F.when(F.col("_over"), 2).otherwise(1).alias("rank"), (F.col("ord") * 2 + F.col("_k")).cast("long").alias("ord"), "_f.type", "_f.severity", "_f.title", "_f.description", F.col("path").alias("file"), "line", "_f.recommendation", F.lit(CWE).alias("cve"))


def secret_rows(found: DataFrame) -> DataFrame:
    """Findings of ``secret_findings`` in the columns of FINDING, after those about packages."""
    by = F.col("file_ord").cast("long") * 1_000_000_000 + F.col("line") * 100 + F.col("seq")
    return found.select("scan_id", F.lit(3).alias("rank"), by.cast("long").alias("ord"), "type", "severity", "title", "description", "file", "line", F.lit("Take the secret out, change it, and keep it outside the code.").alias("recommendation"), "cve")
