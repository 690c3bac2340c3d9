"""Controlled vocabularies, labels and thresholds that results are compared by."""

LABEL_REASON = "Paper Mill"

# Reason flags: output column and the reasons that raise it.
REASON_FLAGS = {
    "is_paper_mill": ("Paper Mill",),
    "is_peer_review_fraud": ("Compromised Peer Review", "Concerns/Issues about Peer Review"),
    "is_rogue_editor": ("Rogue Editor",),
    "is_ai_generated": ("Computer-Aided Content or Computer-Generated Content",),
    "is_image_duplication": ("Duplication of/in Image",),
    "is_third_party_investigation": ("Investigation by Third Party",),
    "is_author_unresponsive": ("Author Unresponsive",),
}
SYSTEMIC_KEYWORDS = ("Paper Mill", "Peer Review", "Rogue Editor", "Computer-Generated", "Image")
FOCUS_COUNTRY = "China"

NATURES = ("Retraction", "Correction", "Expression of concern", "Reinstatement")

MIN_GROUP_RECORDS = 5
RECENT_YEARS = 4

SEVERITY_WEIGHTS = {
    "paper_mill": 0.30, "burst": 0.25, "volume": 0.20, "peer_review": 0.15, "ai": 0.10,
}
STRUCTURAL_WEIGHTS = {"volume": 0.60, "intensity": 0.40}
SEVERITY_TIERS = ((85, "极高"), (70, "高"), (50, "中"))
SEVERITY_REST = "低"
STRUCTURAL_TIERS = ((80, "1_极高"), (65, "2_高"), (45, "3_中"))
STRUCTURAL_REST = "4_低"

AUC_GRADES = ((0.90, "优秀"), (0.80, "良好"), (0.70, "可用"), (0.60, "偏弱"))
AUC_REST = "接近随机"
SCORE_NAMES = {
    "risk_score": "risk_score（严重度分，含标签特征 → 有泄漏）",
    "structural_score": "structural_score（结构分，无标签特征 → 可信）",
}
HIGHER_IS_SUSPICIOUS = "取值越大越可疑"
LOWER_IS_SUSPICIOUS = "取值越小越可疑"
LEAKAGE_NOTES = {
    "reason_derived": "⚠ 由 Reason 字段派生，与标签同源，AUC 被高估",
    "structural": "结构性特征，可用于预测",
}

EVENT_WINDOW = (-3, 2)
LAST_FULL_YEAR = 2025
EVENT_GROUPS = {True: "论文工厂", False: "其他撤稿"}

MIN_SHARED_WORKS = 2
MIN_CLUSTER_AUTHORS = 3
CLUSTER_SEVERITY_WEIGHTS = {
    "paper_mill_edge_share": 0.40, "density": 0.25, "works_per_author_year": 0.20,
    "field_journal_ratio": 0.15,
}
CLUSTER_STRUCTURAL_WEIGHTS = {
    "density": 0.45, "works_per_author_year": 0.35, "field_journal_ratio": 0.20,
}
CLUSTER_SCORE_NAMES = {
    "cluster_risk_score": "严重度分（含标签特征 → 有泄漏）",
    "cluster_structural_score": "结构分（零标签特征 → 可信）",
}

BLANK_ROW_REASON = "完全空白行（上游数据瑕疵，已交叉验证）"

# Our own wording.
NULL_KEY_REASON = "work without an id"
BROKEN_LINE_REASON = "line that does not fit the header, in quarantine"
BROKEN_PAGE_REASON = "page that could not be read, in quarantine"

#: What columns mean, written with the tables that have them.
COLUMN_COMMENTS = {
    "record_id": "number of the record in its source; null where the source has no number",
    "work_id": "last part of the work's address",
    "author_id": "last part of the author's address",
    "cluster_id": "smallest author of the cluster",
    "journal": "journal as the record spells it, cleaned",
    "publisher": "publisher as the record spells it, cleaned",
    "country": "one country of the record",
    "reason": "one reason of the record",
    "subject": "one subject of the record, with its code",
    "institution": "one institution of the record",
    "author_position": "place in the list of authors, from 1",
    "retraction_date": "day of the notice, null where it does not parse",
    "original_paper_date": "day of the paper, null where it does not parse",
    "retraction_year": "year of the notice",
    "retraction_latency_days": "days from the paper to the notice",
    "retraction_nature": "kind of notice, from a fixed vocabulary",
    "doi": "identifier in lower case, without address",
    "original_paper_doi": "identifier of the paper in lower case, without address",
    "publication_year": "year of the work",
    "cited_by_count": "citations",
    "n_authors": "number of authors",
    "n_retractions": "number of records",
    "paper_mill_share": "share of records with a paper-mill reason, 0 to 1",
    "burst_ratio": "share of the records that fall in the busiest year",
    "risk_score": "weighted ranks of the risk features, 0 to 100",
    "structural_score": "the same without features derived from the label",
    "risk_tier": "class of the risk score",
    "event_time": "years since the notice",
    "auc": "chance that a positive ranks above a negative",
    "density": "edges over possible edges",
    "source_file": "file that the row was read from",
    "loaded_at": "time of the load",
    "problem": "why the row could not be read; null for good rows",
    "drop_reason": "why rows were dropped",
}
