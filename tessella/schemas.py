"""Schemas of the engine's tables, as DDL. Nothing is inferred."""

LOCUS = "struct<cx: double, cy: double, r: double>"
STUDIES = "study_id string, image_paths array<string>, findings_text string, impression_text string, indication string, mesh array<string>, notes array<string>"
FINDINGS = f"study_id string, reader string, ord long, label string, prob double, source string, locus {LOCUS}, evidence_id string, raw_label string, image_ref string, notes array<string>, needs_human boolean"
DESCRIPTIONS = "study_id string, label string, text string, raw_label string"
READS = "study_id string, reader string, latency_ms long, tokens long, notes array<string>"
DISAGREEMENTS = "study_id string, label string, a_prob double, b_prob double, kind string, in_vocabulary boolean"
ALERTS = "study_id string, label string, prob double, source string, image_ref string, detected_at timestamp_ntz"
SENTENCES = "study_id string, pos int, text string, section string, evidence_ids array<string>"
OPERATING_POINTS = "label string, n_pos long, n_neg long, auc double, critical boolean, threshold double, specificity double, sensitivity double, rule string"
TRACE = "study_id string, node string, ts double"
RUNS = "run_id string, study_id string, status string, created_at double, alert_count int, payload string"
GUIDELINES = "id string, text string, meta struct<topic: string, view: string, critical: boolean>"
PHI = "seed int, report_text_before string, report_text_after string, dicom_attributes map<string, string>, ground_truth array<struct<kind: string, value: string, location: string>>"
GOLD = "study_id string, image_path string, expected_critical array<string>, source string, note string"
