"""Rules that put texts and names into classes by keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritgrid.operators.privacy import keyword_hits

# The words that tell kinds of query, in the order in which ties are decided.
QUERY_WORDS = {
    "drug_discovery": [
        "drug", "compound", "inhibitor", "agonist", "antagonist", "pharmacol",
        "medicinal chemistry", "target", "binding", "ic50", "ec50", "adme",
        "toxicology", "formulation", "bioavailability", "lead optimization",
        "hit-to-lead", "scaffold", "sar", "structure-activity",
    ],
    "clinical_trial_pi": [
        "clinical trial", "trial investigator", "principal investigator",
        "phase 1", "phase 2", "phase 3", "phase i", "phase ii", "phase iii",
        "enrollment", "randomized", "placebo", "endpoint", "irb",
        "site investigator", "clinical study", "protocol",
    ],
    "policy_epi": [
        "epidemiology", "population health", "public health", "policy",
        "health economics", "surveillance", "outbreak", "vaccine coverage",
        "health equity", "social determinants", "disparity", "mortality rate",
        "incidence", "prevalence", "cohort study", "case-control",
    ],
}
SOURCE_TYPES = {"pubmed": "publication", "openalex": "publication", "clinicaltrials": "trial", "nih_reporter": "grant"}


def keyword_class(text: Column, words: dict[str, list[str]], otherwise: str) -> tuple[Column, Column]:
    """The class with the most of its words in the text, the first of equals, and the number of hits."""
    counts = {k: keyword_hits(text, w) for k, w in words.items()}
    best = F.greatest(*counts.values(), F.lit(0)) if len(counts) > 1 else next(iter(counts.values()))
    out = F.when(best == 0, otherwise)
    for name, n in counts.items():
        out = out.when(n == best, name)
    return out, best


def query_class(text: Column) -> tuple[Column, Column]:
    """Kind of query and confidence."""
    kind, hits = keyword_class(text, QUERY_WORDS, "basic_research")
    return kind, F.round(F.when(hits == 0, 0.5).otherwise(F.least(0.5 + hits * 0.1, F.lit(0.95))), 3)


def artifact_type(source: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SOURCE_TYPES.items() for x in kv))[source], F.lit("publication"))


def sanction_action(text: Column) -> tuple[Column, Column]:
    """Action and severity of a change to a sanctions list."""
    gone = F.lower(text).rlike("remov|delist")
    return F.when(gone, "removed").otherwise("added"), F.when(gone, "low").otherwise("critical")


def rule_based_specialty(npi: Column, abms: Column, patents: Column, papers: Column) -> tuple[Column, Column]:
    """Specialty and confidence without a model."""
    clinical, patent = npi | abms, patents > papers
    name = F.when(clinical, "clinician").when(patent, "drug_discovery").otherwise("translational")
    return name, F.when(clinical | patent, 0.7).otherwise(0.6)


def settled_specialty(distribution: Column) -> tuple[Column, Column]:
    """The likeliest specialty of a map of probabilities and whether it is settled (at least 0.6)."""
    top = F.array_max(F.transform(F.map_entries(distribution), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("s"))))
    return F.coalesce(top["s"], F.lit("translational")), F.coalesce(top["p"] >= 0.6, F.lit(False))


#: What papers, trials and grants in the specialty weigh, and from where on a specialty is clear.
MIX_WEIGHTS, CLEAR_MIX = (0.5, 0.3, 0.2), 0.7


def mix_flags(candidates: DataFrame, threshold: float = CLEAR_MIX) -> DataFrame:
    """`candidates` (n_papers, n_trials, n_grants, each also as `<name>_in`: those in the specialty) with the shares, the
    weighted confidence and whether the specialty is ambiguous."""
    shares = {k: F.col(f"n_{k}_in") / F.greatest(F.col(f"n_{k}"), F.lit(1)) for k in ("papers", "trials", "grants")}
    confidence = sum((F.lit(w) * s for w, s in zip(MIX_WEIGHTS, shares.values(), strict=True)), F.lit(0.0))
    named = {f"{k[:-1]}_ratio": s for k, s in shares.items()}
    return candidates.withColumns({**named, "confidence": confidence, "ambiguous": confidence < threshold})
