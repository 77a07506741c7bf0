"""Fixed lookup lists of the domain, and their form as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The word lists below must equal the published ones for right results.

NARROW_MACHINERY = [
    "HDAC inhibitor", "topoisomerase inhibitor", "CDK inhibitor", "tubulin inhibitor",
    "proteasome inhibitor", "mTOR inhibitor", "DNA synthesis inhibitor",
    "RNA synthesis inhibitor", "protein synthesis inhibitor", "ATPase inhibitor",
    "DNA alkylating agent", "ribonucleotide reductase inhibitor",
]

NARROW_KINASE = [
    "EGFR inhibitor", "MEK inhibitor", "MAPK inhibitor", "SRC inhibitor", "PI3K inhibitor",
    "JAK inhibitor", "FLT3 inhibitor", "VEGFR inhibitor", "PDGFR inhibitor", "ABL inhibitor",
    "RAF inhibitor", "Aurora kinase inhibitor", "PKC inhibitor",
]

NARROW_RECEPTOR = [
    "dopamine receptor agonist", "dopamine receptor antagonist",
    "serotonin receptor agonist", "serotonin receptor antagonist",
    "histamine receptor antagonist",
    "adrenergic receptor agonist", "adrenergic receptor antagonist",
    "acetylcholine receptor agonist", "acetylcholine receptor antagonist",
    "glutamate receptor antagonist", "glutamate receptor agonist",
    "opioid receptor agonist", "opioid receptor antagonist",
    "calcium channel blocker", "sodium channel blocker", "potassium channel blocker",
    "GABA receptor agonist", "GABA receptor antagonist",
    "cannabinoid receptor agonist", "cannabinoid receptor antagonist",
    "benzodiazepine receptor agonist",
]

BROAD_MACHINERY = [
    "HDAC inhibitor", "topoisomerase inhibitor", "CDK inhibitor", "proteasome inhibitor",
    "mTOR inhibitor", "DNA synthesis inhibitor", "RNA synthesis inhibitor",
    "protein synthesis inhibitor", "ATPase inhibitor", "DNA alkylating agent",
    "ribonucleotide reductase inhibitor", "tubulin inhibitor",
    "tubulin polymerization inhibitor", "PARP inhibitor", "thymidylate synthase inhibitor",
    "dihydrofolate reductase inhibitor", "histone methyltransferase inhibitor",
    "histone demethylase inhibitor", "DNA methyltransferase inhibitor", "BET inhibitor",
    "sirtuin inhibitor", "cell cycle inhibitor", "MDM inhibitor", "autophagy inhibitor",
    "HSP inhibitor", "NFkB pathway inhibitor",
]

BROAD_KINASE = [
    "EGFR inhibitor", "MEK inhibitor", "MAPK inhibitor", "p38 MAPK inhibitor", "SRC inhibitor",
    "PI3K inhibitor", "JAK inhibitor", "FLT3 inhibitor", "VEGFR inhibitor", "PDGFR inhibitor",
    "ABL inhibitor", "RAF inhibitor", "PKC inhibitor", "AKT inhibitor",
    "glycogen synthase kinase inhibitor", "IKK inhibitor", "rho associated kinase inhibitor",
    "tyrosine kinase inhibitor", "checkpoint kinase inhibitor", "ALK inhibitor",
    "BTK inhibitor", "KIT inhibitor", "Aurora kinase inhibitor",
]

BROAD_RECEPTOR = [
    "dopamine receptor", "serotonin receptor", "histamine receptor", "adrenergic receptor",
    "acetylcholine receptor", "glutamate receptor", "opioid receptor", "cannabinoid receptor",
    "adenosine receptor", "angiotensin receptor", "prostanoid receptor",
    "tachykinin antagonist", "leukotriene receptor", "endothelin receptor",
    "benzodiazepine receptor", "calcium channel blocker", "T-type calcium channel blocker",
    "sodium channel blocker", "potassium channel blocker", "potassium channel activator",
    "GABA receptor",
]

NUCLEAR_RECEPTOR = [
    "glucocorticoid receptor", "estrogen receptor", "androgen receptor",
    "progesterone receptor", "PPAR receptor", "retinoid receptor", "vitamin D receptor",
    "mineralocorticoid receptor",
]

CONSTITUTIVE_MACHINERY = [
    "proteasome inhibitor", "tubulin inhibitor", "tubulin polymerization inhibitor",
    "HDAC inhibitor", "topoisomerase inhibitor",
]

NARROW_CONSTITUTIVE_MACHINERY = [
    "proteasome inhibitor", "tubulin inhibitor", "tubulin polymerization inhibitor",
]

HDAC_SYNONYMS = ["histone deacetylase", "class i hdac", "class ii hdac", "pan-hdac", "sirtuin"]

STRESS_APOPTOSIS_GENES = [
    "HSPA1A", "HSPA1B", "HSP90AA1", "HSPA5", "HSPB1", "DNAJB1",
    "BAX", "BCL2", "CASP3", "CASP8", "CASP9", "CYCS", "APAF1",
    "TP53", "MDM2", "CDKN1A", "GADD45A", "GADD45B",
    "ATF4", "DDIT3", "XBP1", "ATF6", "EIF2AK3",
    "NFKB1", "RELA", "TNF", "IL6", "IL1B",
    "FOS", "JUN", "EGR1", "MYC",
    "HMOX1", "NQO1", "GCLM", "TXNRD1",
    "CCND1", "CCNE1", "CDK4", "CDK2", "RB1",
]

KNOWN_CYTOTOXIC = [
    "staurosporine", "camptothecin", "doxorubicin", "etoposide", "cisplatin", "vincristine",
    "paclitaxel", "actinomycin-d", "thapsigargin", "tunicamycin", "brefeldin-a", "rotenone",
    "antimycin-a", "oligomycin-a", "menadione", "hydrogen-peroxide",
]

KNOWN_BROAD_THERAPEUTICS = [
    "vorinostat", "trichostatin-a", "panobinostat", "sirolimus", "dexamethasone",
    "methotrexate", "atorvastatin", "simvastatin", "lovastatin", "metformin",
]

BROAD_MECHANISM_DRUGS = [
    "atorvastatin", "simvastatin", "lovastatin", "metformin", "dexamethasone", "sirolimus",
    "methotrexate", "aspirin", "vorinostat", "trichostatin-a",
]

CONTEXT_SPECIFIC_DRUGS = [
    "vemurafenib", "imatinib", "erlotinib", "crizotinib", "lapatinib", "gefitinib",
    "PCI-34051", "tubastatin-a",
]

SILENCING_EFFECTS = {
    "PL": 0.3333, "ORB": 0.3085, "VISpm": 0.2248, "MOp": 0.1869, "SSp": 0.1862, "VISl": 0.1722,
    "SSs": 0.1600, "MOs": 0.1529, "ACA": 0.1451, "RSP": 0.1421, "VISp": 0.1414, "VISam": 0.0818,
}

DOSE_RATIO_EDGES = [1, 2, 5, 20, 100, 10000]
DOSE_RATIO_LABELS = ["1-2x", "2-5x", "5-20x", "20-100x", "100x+"]

PENALTY_SWEEP = [0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]

# End of fixed values.

NARROW_CLASSES = [("machinery", NARROW_MACHINERY), ("kinase", NARROW_KINASE),
                  ("receptor", NARROW_RECEPTOR)]
BROAD_CLASSES = [("excluded", NUCLEAR_RECEPTOR), ("machinery", BROAD_MACHINERY),
                 ("kinase", BROAD_KINASE), ("receptor", BROAD_RECEPTOR)]


def name_table(spark: SparkSession, names: list[str], column: str = "name") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def silencing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SILENCING_EFFECTS.items()), "region string, silencing_effect double")
