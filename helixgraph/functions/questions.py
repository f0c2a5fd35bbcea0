"""Column functions that read questions: kind, relation, entities, target. Rules apply in the order in which they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relations and their patterns; the first relation with a pattern that the question matches is taken.
RELATION_PATTERNS = (
    ("protein_interaction", (
        r"interact(?:s|ing)?\s+with",
        r"protein[s]?\s+(?:does|do|that)\s+.*\s+interact",
        r"show\s+interaction",
        r"interacting\s+proteins?",
    )),
    ("protein_disease", (
        r"disease[s]?\s+(?:are|is)\s+associated",
        r"associated\s+(?:with\s+)?disease",
        r"disease[s]?\s+.*\s+linked",
        r"what\s+disease",
        r"which\s+disease",
    )),
    ("protein_pathway", (
        r"pathway[s]?\s+(?:are|is)",
        r"annotated\s+(?:in|to)\s+pathway",
        r"(?:in|to)\s+(?:which|what)\s+pathway",
        r"which\s+pathway",
        r"what\s+.*\s+pathway",
    )),
    ("protein_biological_process", (
        r"biological\s+process(?:es)?",
        r"(?:what|which)\s+biological",
    )),
    ("protein_molecular_function", (
        r"molecular\s+function[s]?",
        r"(?:what|which)\s+.*\s+molecular\s+function",
        r"function\s+of\s+(?:the\s+)?protein",
    )),
    ("protein_cellular_component", (
        r"cellular\s+component[s]?",
        r"(?:what|which)\s+cellular",
        r"locali[sz](?:ed|ation)",
    )),
    ("protein_tissue", (
        r"tissue[s]?\s+(?:are|is)",
        r"expressed\s+in.*tissue",
        r"(?:what|which)\s+tissue",
    )),
    ("gene_protein", (
        r"protein\s+translated\s+from",
        r"gene\s+.*\s+translat",
    )),
    ("gene_molecular_function", (
        r"molecular\s+function\s+of\s+.*\s+protein\s+translated\s+from\s+.*\s+gene",
        r"function\s+.*\s+gene",
    )),
    ("gene_biological_process", (
        r"biological\s+process\s+.*\s+gene",
    )),
)
#: Identifiers in questions, and words in capitals that are no genes.
UNIPROT = r"\b[PQO][0-9][A-Z0-9]{3}[0-9](?:-[0-9]+)?\b"
GENE_NAMED = r"(?i)\bgene\s+([A-Za-z][A-Za-z0-9\-]+)\b"
GENE_SYMBOL = r"\b[A-Z]{2,6}[0-9]*\b"
GO_TERM = r"GO:[0-9]{7}"
RSID = r"(?i)\brs[0-9]+\b"
NO_GENES = ("THE", "AND", "FOR", "WITH", "WHAT", "WHICH", "ARE", "DOES", "FROM", "THAT", "THIS", "BOTH", "ALL")
#: What an answer to each relation is.
TARGETS = {
    "protein_interaction": "Protein",
    "protein_disease": "Disease",
    "protein_pathway": "Pathway",
    "protein_biological_process": "Biological_process",
    "protein_molecular_function": "Molecular_function",
    "protein_cellular_component": "Cellular_component",
    "protein_tissue": "Tissue",
    "gene_protein": "Protein",
    "gene_molecular_function": "Molecular_function",
    "gene_biological_process": "Biological_process",
}
#: Words by which a question's target is inferred where it has no relation, the first counts.
TARGET_WORDS = (
    ("biological process", "Biological_process"),
    ("molecular function", "Molecular_function"),
    ("cellular component", "Cellular_component"),
    ("pathway", "Pathway"),
    ("disease", "Disease"),
    ("tissue", "Tissue"),
    ("interact", "Protein"),
    ("protein", "Protein"),
    ("gene", "Gene"),
)


def kind(c: Column) -> Column:
    """conjunction, multi-hop or one-hop."""
    low = F.lower(c)
    several = low.contains(" and ") & (low.contains("both") | low.contains("all"))
    return F.when(several, "conjunction").when(low.contains("gene") & (low.contains("protein") | low.contains("translated")), "multi-hop").otherwise("one-hop")


def relation(c: Column) -> Column:
    out, low = F.lit("unknown"), F.lower(c)
    for name, patterns in reversed(RELATION_PATTERNS):
        out = F.when(low.rlike("|".join(patterns)), name).otherwise(out)
    return out


def target(relation_of: Column, c: Column) -> Column:
    """What is asked for: by the relation, else by the words of the question."""
    inferred, low = F.lit("unknown"), F.lower(c)
    for word, label in reversed(TARGET_WORDS):
        inferred = F.when(low.contains(word), label).otherwise(inferred)
    entries = [F.lit(x) for item in TARGETS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*entries), relation_of), inferred)


def proteins(c: Column) -> Column:
    """UniProt accessions in their order."""
    return F.regexp_extract_all(c, F.lit(UNIPROT), F.lit(0))


def gene(c: Column) -> Column:
    """The name after the word gene, in capitals; null without one."""
    name = F.regexp_extract(c, GENE_NAMED, 1)
    return F.when(name != "", F.upper(name))


def gene_symbols(c: Column) -> Column:
    """Words of two to six capitals, digits after them, that aren't common words."""
    return F.filter(F.regexp_extract_all(c, F.lit(GENE_SYMBOL), F.lit(0)), lambda g: ~g.isin(*NO_GENES))


def go_terms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(GO_TERM), F.lit(0))


def rsids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(RSID), F.lit(0))


def answer_class(c: Column) -> Column:
    """count, boolean, list or entity; unknown for a null or empty question."""
    low = F.lower(c)
    yes_no = F.lit(False)
    for word in ("is ", "are ", "does ", "do ", "can ", "has ", "have "):
        yes_no = yes_no | low.startswith(word)
    return (
        F.when(F.coalesce(c == "", F.lit(True)), "unknown")
        .when(low.contains("how many") | low.contains("count") | low.contains("number of"), "count")
        .when(yes_no, "boolean")
        .when(low.contains("list") | low.contains("all the") | low.contains("name all"), "list")
        .otherwise("entity")
    )
