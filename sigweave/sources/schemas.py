"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

SIGNATURES = T.StructType([T.StructField("sig_id", T.StringType()),
                           T.StructField("vec", T.ArrayType(T.DoubleType()))])
FEATURES = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("feature_id", T.StringType()),
                         T.StructField("symbol", T.StringType())])
SIG_INFO = T.StructType([T.StructField(c, T.StringType())
                         for c in ("sig_id", "pert_iname", "cell_id", "pert_type", "pert_dose")])
SCORES = T.StructType([
    T.StructField("drug_name", T.StringType()), T.StructField("moa", T.StringType()),
    T.StructField("n_cell_lines", T.IntegerType()), T.StructField("direction_instability", T.DoubleType()),
    T.StructField("magnitude_cv", T.DoubleType()), T.StructField("frechet_variance", T.DoubleType()),
    T.StructField("mean_top_gene_jaccard", T.DoubleType()), T.StructField("mean_norm", T.DoubleType())])
HOLDOUT = T.StructType([
    T.StructField("drug", T.StringType()), T.StructField("mean_heldout_cosine", T.DoubleType()),
    T.StructField("frac_consistent", T.DoubleType()), T.StructField("mean_loo_di", T.DoubleType())])
LABELS = T.StructType([T.StructField("drugs", T.ArrayType(T.StructType([
    T.StructField(c, T.StringType()) for c in ("pert_iname", "target", "moa")])))])
CELLS = T.StructType([T.StructField("cell_id", T.StringType()), T.StructField("perturbation", T.StringType())])
CELL_EXPRESSION = T.StructType([T.StructField("cell_id", T.StringType()), T.StructField("feature", T.StringType()),
                                T.StructField("x", T.DoubleType())])
EFFECTS = T.StructType([T.StructField("k562_effect", T.DoubleType()), T.StructField("rpe1_effect", T.DoubleType())])
GEODESICS = T.StructType([T.StructField("geodesic_distance", T.DoubleType())])
