"""Fixed values of the scoring rules: weights, lookup tables, thresholds and word lists."""

#: Scores of clinical significances.
CLINICAL_SCORES = {
    "pathogenic": 1.0,
    "likely_pathogenic": 0.8,
    "uncertain_significance": 0.3,
    "likely_benign": 0.1,
    "benign": 0.0,
    "not_in_clinvar": 0.0,
    "not_annotated": 0.0,
}
#: Scores of variant consequences.
CONSEQUENCE_SCORES = {
    "transcript_ablation": 1.0,
    "splice_acceptor_variant": 1.0,
    "splice_donor_variant": 1.0,
    "stop_gained": 1.0,
    "frameshift_variant": 1.0,
    "stop_lost": 1.0,
    "start_lost": 1.0,
    "missense_variant": 0.7,
    "inframe_insertion": 0.6,
    "inframe_deletion": 0.6,
    "protein_altering_variant": 0.6,
    "splice_region_variant": 0.3,
    "splice_donor_5th_base_variant": 0.3,
    "splice_polypyrimidine_tract_variant": 0.3,
    "synonymous_variant": 0.3,
    "intron_variant": 0.1,
    "intergenic_variant": 0.1,
    "upstream_gene_variant": 0.1,
    "downstream_gene_variant": 0.1,
    "3_prime_UTR_variant": 0.1,
    "5_prime_UTR_variant": 0.1,
    "non_coding_transcript_exon_variant": 0.1,
    "regulatory_region_variant": 0.1,
    "NMD_transcript_variant": 0.1,
    "not_annotated": 0.0,
    "": 0.0,
}
#: Thresholds of quality control.
GENOME_WIDE, MAF_LEAST, MAF_MOST, WINDOW = 5e-8, 0.001, 0.5, 500_000
#: Weights of the extended score: risk, effect, clinical, consequence, evidence.
EXTENDED_WEIGHTS = {"risk": 0.65, "effect": 0.00, "clinical": 0.05, "consequence": 0.10, "evidence": 0.20}
#: Weights of risk: evidence and causality; share of the SNP-count bonus of a gene.
EVIDENCE_WEIGHT, CAUSAL_WEIGHT, COUNT_BONUS = 0.3, 0.7, 0.3
#: Weights of the composite of reasoning categories, the penalty of hallucination, and the calibration error assumed.
CATEGORY_WEIGHTS = {"S": 0.25, "C": 0.30, "R": 0.25, "M": 0.20}
HALLUCINATION_RATE, ASSUMED_ECE = 6.9, 0.1
