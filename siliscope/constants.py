"""Fixed values of the data contract: grades, classes, vocabularies and thresholds."""

# fixed values: defect classes of the label masks, and those that are scored
PATTERN_CLASSES = ("scratch", "ring", "edge", "local", "random", "shot_grid", "stby_pattern")
REPORT_CLASSES = ("scratch", "ring", "edge", "local", "shot_grid", "stby_pattern")
CLASS_PRIORITY = {"scratch": 0, "local": 1, "edge": 2, "ring": 3, "shot_grid": 4, "stby_pattern": 5}

# fixed values: gray code of the grades 0..7, and the code of an untested chip
GRADE_GRAYS = (0, 31, 151, 175, 191, 207, 223, 255)
STBY_GRAY = 255
MAX_GRADE = 7

# fixed values: manifest versions, source types and id patterns
MANIFEST_VERSION = "real_unlabeled_manifest/v1"
FEATURE_VERSION = "observable_fbm_features/v1"
SOURCE_NPZ = "npz_semantic_arrays"
SOURCE_PNG = "png_grayscale_raw"
SOURCE_DIR = "synthetic_sample_dir"
SAMPLE_ID_PATTERN = "^[A-Za-z0-9_.-]+$"
OPAQUE_ID_PATTERN = "^product_[0-9a-f]{10}_w[0-9a-f]{10}$"

# fixed values: vocabularies of the review form
REVIEW_DECISIONS = ("same_family", "partial_match", "mismatch", "not_sure")
DEFECT_FAMILIES = ("edge", "shot_grid", "stby_pattern", "stby_hidden_origin", "ring", "scratch", "local",
                   "random", "mixed", "none", "unknown")
CLOCK_MATCHES = ("yes", "partial", "no", "not_applicable")
MISSED_VALUES = ("yes", "no", "not_sure")
FAILURE_MODES = ("none", "wrong_family", "right_family_wrong_location", "missed_query_defect", "missed_scratch",
                 "missed_shot_grid", "missed_ring", "missed_local", "missed_stby_origin",
                 "scratch_orientation_span_mismatch", "shot_phase_layout_mismatch", "ring_radius_width_mismatch",
                 "local_blob_topology_mismatch", "stby_hidden_origin_mismatch", "severity_scale_mismatch",
                 "parser_or_mask_issue", "wrong_clock_position", "overweighted_stby", "overweighted_edge",
                 "mixed_confounder", "insufficient_evidence", "other", "not_sure")
NEXT_ACTIONS = ("keep_baseline", "feature_weight_tuning", "tune_observable_feature", "add_location_aware_feature",
                "add_scratch_component_features", "add_shot_phase_features", "add_ring_radius_width_features",
                "add_local_topology_features", "add_stby_origin_coupling_features", "segmentation_candidate",
                "scratch_specific_track", "parser_validation", "review_more_samples", "deprioritize_pair",
                "not_sure")
REVIEW_VOCAB = {
    "reviewer_decision": REVIEW_DECISIONS,
    "query_defect_family": DEFECT_FAMILIES,
    "neighbor_defect_family": DEFECT_FAMILIES,
    "dominant_defect": DEFECT_FAMILIES,
    "clock_position_match": CLOCK_MATCHES,
    "missed_major_defect": MISSED_VALUES,
    "retrieval_failure_mode": FAILURE_MODES,
    "next_action": NEXT_ACTIONS,
}
REVIEW_COLUMNS = ("review_case_id", "query_sample_id", "rank", "neighbor_sample_id", "distance",
                  "reviewer_decision", "query_defect_family", "neighbor_defect_family", "dominant_defect",
                  "clock_position_match", "missed_major_defect", "retrieval_failure_mode", "next_action",
                  "safe_comment")
NEIGHBOR_COLUMNS = ("query_sample_id", "rank", "neighbor_sample_id", "distance")

# fixed values: columns of a feature table that are never searched on
NON_FEATURE_COLUMNS = ("sample_id", "actual_net_die", "cluster_id", "pca_0", "pca_1")
