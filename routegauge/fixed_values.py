"""Texts, formats, patterns and constants that results must reproduce exactly."""

# --- Fixed values: prompts and markers -------------------------------------------------------------

RANK_SYSTEM = "You are an information retrieval assistant."

MOVIE_SYSTEM = (
    "You are a recommendation assistant. Select exactly 10 items from the candidate set and "
    "provide a ranked list of movie IDs. Ensure all selected items belong to the candidate set. "
    "Consider both session interactions and user history. You may include reasoning inside "
    "<thought></thought> when needed.\n"
    "## Output Format\n"
    "<output>Recommendation result: [MOVIE IDS IN ORDER, SEPARATED BY COMMA]</output>"
)

GAME_SYSTEM = (
    "You are a recommendation assistant. Select exactly 10 items from the candidate set and "
    "provide a ranked list of game IDs. Ensure all selected items belong to the candidate set. "
    "Consider both session interactions and user history. You may include reasoning inside "
    "<thought></thought> when needed.\n"
    "## Output Format\n"
    "<output>Recommendation result: [GAME IDS IN ORDER, SEPARATED BY COMMA]</output>"
)

ASSISTANT_PREFIX = {"direct": "<output>", "CoT": "<thought>", "agent": ""}

ITEM_MARK = "§"
UNKNOWN_TITLE = "[Unknown Title]"
UNKNOWN_GENRES = "[Unknown Genres]"

HISTORY_HEADER = "User's watched history:"
CANDIDATE_HEADER = "Candidate items:"

IR_AGENT_LAYOUT = (
    "{task}.\n\n"
    "### Inputs\n"
    "- {query}.\n\n"
    "- **Candidate Passages**:\n"
    "{candidates_block}\n\n"
    "When generating the results:\n"
    "- Ensure all IDs belong to the provided candidate set.\n"
    "- You may include reasoning inside <thought></thought> if needed.\n\n"
    "### Constraints\n"
    "- Include all passage IDs in descending order of relevance.\n"
    "- Do not invent new IDs.\n\n"
    "### Output Format\n"
    "<output>[ID1] > [ID2] > ...</output>\n"
)

# --- Fixed values: dataset aliases -----------------------------------------------------------------

MOVIE_ALIASES = ("ml-1m", "movielens", "movie")
GAME_ALIASES = ("amazon-game", "steam", "game")
IR_ALIASES = ("rank_ir", "retrieval", "ir")
REC_KINDS = ("ml-1m", "amazon-game")

# --- Fixed values: answer patterns (Java regular expressions) --------------------------------------

REC_TAGGED = (
    r"(?isU)<output>\s*(?:Ranking|Recommendation)\s+result\s*:\s*"
    r"(?:\[(.*?)\]|([\d,\s，]+))\s*</output>"
)
REC_INLINE = r"(?isU)(?:Ranking|Recommendation)\s+result\s*:\s*(?:\[(.*?)\]|([\d,\s，]+))"
REC_BARE_LIST = r"(?U)\A\s*\d+(?:\s*,\s*\d+)*\s*\z"
REC_BRACKET = r"(?s)\[(.*?)\]"
IR_TAGGED = r"(?is)<output>(.*?)</output>"
IR_BRACKET_ID = r"\[([A-Za-z0-9]+)\]"

# --- Fixed values: line patterns of prompts (applied to single lines) ------------------------------

HISTORY_HEADER_LINE = r"(?i)\A[ \t]*User's[ \t]+watched[ \t]+history:\s*\z"
CANDIDATE_HEADER_LINE = r"(?i)\A[ \t]*Candidate[ \t]+items:\s*\z"
MOVIE_ITEM_LINE = r"(?d)\A§\s*ID\s*:\s*(\d+)\s+Title\s*:\s*(.+?)(?:\s*;\s*Genres\s*:\s*.*)?\s*\z"
GAME_ITEM_LINE = r"(?d)\A§\s*ID\s*:\s*(\d+)\s+Title\s*:\s*(.+?)\s*\z"
GENERIC_ITEM_LINE = r"\A§\s*ID\s*:\s*(\d+)\s*\z"
PASSAGES_HEADER_LINE = r"(?i)\A\s*(?:-\s*)?\*\*Candidate\s+Passages\*\*\s*:\s*\z"
PASSAGES_END_LINE = r"(?i)\A\s*###\s*(?:Constraints|Output\s*Format)\s*\z"
QUERY_TEXT = r"(?imd)^\s*(?:-\s*)?Search\s*Query\s*:\s*(.+?)\s*$"
PASSAGE_START_LINE = r"\A\s*(?:§\s*)?\[([A-Za-z0-9]{1,3})\](?!>)"
PASSAGE_COUNT = r"(?i)I\s+will\s+provide\s+you\s+with\s+(\d+)\s+passages"

# --- Fixed values: evaluation and policy defaults --------------------------------------------------

NONE_VALUE = -1.0
K_RUNS = 5
LAMBDA_COST = 0.1
EPS_EQUAL = 3e-3
ALPHA_VAR = 5.0
TRIM_RATIO = 0.1
DEV_RATIO = 0.25
SPLIT_SEED = 2025
RANK_QUANTILES = (0.5, 0.8, 0.95)
MIN_POSITIVES = 50
ADVANTAGE_ROUNDS = 100
ADVANTAGE_PATIENCE = 10
RANKER_ROUNDS = 2000
RANKER_PATIENCE = 200

GENRE_COLUMNS = (
    "history_genre_entropy",
    "candidate_genre_entropy",
    "candidate_avg_popularity",
    "history_avg_popularity",
)

# --- Fixed values: required feature names, in output order ----------------------------------------

IR_KINDS = ("rank_ir", "ir", "retrieval", "search")

REC_FEATURES = (
    "hist_len",
    "hist_embedding_variance",
    "cand_embedding_dispersion",
    "history_candidate_sim_max",
    "history_candidate_sim_mean",
    "history_candidate_sim_min",
    "history_candidate_sim_var",
    "history_candidate_sim_p50",
    "history_candidate_sim_p75",
    "history_candidate_sim_p90",
    "history_candidate_sim_p95",
    "history_candidate_sim_top1_top2_gap",
    "top1_sim",
    "top10_sim",
    "top_k_sim_gap",
    "cand_pairwise_cos_mean",
    "cand_pairwise_cos_std",
    "cand_pairwise_cos_min",
    "cand_centroid_norm",
    "cand_cov_trace",
    "cand_pca_singular_top3_sum",
    "hist_adj_cos_mean",
    "hist_adj_cos_std",
    "hist_drift_cos",
    "hist_cov_trace",
    "hist_pca_singular_top3_sum",
    "cand_sim_>0.3_ratio",
    "cand_sim_>0.5_ratio",
    "cand_sim_>0.7_ratio",
    "cand_cluster_size_entropy_k3",
    "ambiguous_cluster_score",
    "hist_cand_centroid_cos",
    "hist_cand_centroid_dist",
    "c2h_recentK_mean",
    "c2h_recentK_max",
    "cand_density_wrt_hist",
)

IR_FEATURES = (
    "query_norm",
    "cand_embedding_dispersion",
    "cand_pairwise_cos_mean",
    "cand_pairwise_cos_std",
    "cand_pairwise_cos_min",
    "cand_centroid_norm",
    "cand_cov_trace",
    "cand_pca_singular_top3_sum",
    "query_candidate_sim_max",
    "query_candidate_sim_mean",
    "query_candidate_sim_min",
    "query_candidate_sim_var",
    "query_candidate_sim_p50",
    "query_candidate_sim_p75",
    "query_candidate_sim_p90",
    "query_candidate_sim_p95",
    "top1_sim",
    "top10_sim",
    "top_k_sim_gap",
    "qc_centroid_cos",
    "qc_centroid_dist",
    "cand_sim_>0.3_ratio",
    "cand_sim_>0.5_ratio",
    "cand_sim_>0.7_ratio",
    "cand_cluster_size_entropy_k3",
    "ambiguous_cluster_score",
    "cand_density_wrt_query",
)

# --- Fixed values: checklist verbalizers and question pairs ----------------------------------------

VERBALIZERS = {
    "yn": {"yes": (" Yes", "Yes", " YES", " yes"), "no": (" No", "No", " NO", " no")},
    "tf": {"yes": (" True", "True"), "no": (" False", "False")},
    "ab": {"yes": (" A", "A"), "no": (" B", "B")},
    "01": {"yes": (" 1", "1"), "no": (" 0", "0")},
}

CHECKLIST_INTRO = (
    "[Checklist]",
    "Please answer each question with exactly one token: 'Yes' or 'No'. If uncertain, answer 'No'.",
    "",
)
CHECKLIST_OUTRO = "Prefix:"

CHECKLIST = {
    "movie": (
        ("Are candidates highly homogeneous in genre/year (e.g., median genre-overlap ≥ 0.8 OR release-year IQR ≤ 3)?",
         "Are candidates thematically diverse across genres/eras/directors (e.g., median genre-overlap ≤ 0.4 OR release-year IQR ≥ 10)?"),
        ("Does the watch history show a dominant genre cluster (≥70% of last 20 movies share the same top-2 genres)?",
         "Does the watch history split across ≥3 unrelated genre clusters with none >40% (multi-intent)?"),
        ("Do candidate titles/genres lexically match the history keywords strongly (e.g., ≥70% top keywords overlap)?",
         "Is lexical overlap weak (≤20%) so semantic bridging beyond keywords is needed?"),
        ("Are there effectively no hard constraints implied?",
         "Must strict constraints be inferred and enforced?"),
        ("Are near-duplicates negligible?",
         "Are many near-duplicate or tightly related entries where subtle tie-breaking is required?"),
        ("Is franchise order irrelevant to ranking?",
         "Does correct watch order matter?"),
        ("Are most candidates mainstream?",
         "Are many candidates long-tail where popularity heuristics are unreliable?"),
        ("Does the user show a stable recent-era preference?",
         "Is there explicit tension requiring trade-off reasoning to balance eras?"),
        ("Can coarse genre signals alone likely determine ranking?",
         "Do fine-grained cues need to be articulated to separate very similar candidates?"),
        ("Is metadata clean?",
         "Is metadata noisy requiring explicit reasoning?"),
    ),
    "game": (
        ("Are platform and hardware constraints obvious and satisfied?",
         "Do platform/VR/GPU/OS constraints need to be inferred or disambiguated?"),
        ("Is the solo vs co-op preference clear?",
         "Is solo vs co-op preference ambiguous/contradictory and critical?"),
        ("Do session-length patterns match candidates directly?",
         "Do loop depth/grind length/endgame needs require explicit reasoning?"),
        ("Are monetization/DLC issues irrelevant?",
         "Are DLC bundles/editions/paywalls decisive?"),
        ("Is franchise continuity irrelevant?",
         "Does correct entry-point in a franchise matter?"),
        ("Is online population/latency not a deciding factor?",
         "Is community health/region/latency critical?"),
        ("Are age rating/toxicity concerns irrelevant?",
         "Must age-rating/toxicity constraints be enforced?"),
        ("Do mainstream titles dominate?",
         "Are many indie/long-tail titles where naive priors fail?"),
        ("Are control/accessibility requirements non-critical?",
         "Do control/accessibility constraints drive ranking?"),
        ("Can coarse genre tags alone decide ranking?",
         "Do sub-genre/mechanics nuances require explicit reasoning?"),
    ),
    "ir": (
        ("Is the query single-intent and unambiguous?",
         "Is the query ambiguous or multi-intent?"),
        ("Do top candidates have strong lexical overlap with the query?",
         "Is there a lexical–semantic mismatch requiring paraphrase/bridging?"),
        ("Can a single passage fully answer the query?",
         "Is the answer scattered and requires aggregation?"),
        ("Are near-duplicates rare?",
         "Are many near-duplicate/tie passages requiring subtle weighing?"),
        ("Is temporal reasoning irrelevant?",
         "Is temporal reasoning essential?"),
        ("Does the query avoid negation/exception/scope?",
         "Does ranking depend on handling negation/exception/scope precisely?"),
        ("Do domain terms/acronyms map unambiguously?",
         "Do they require disambiguation?"),
        ("Is jurisdiction/entity-type constraint irrelevant?",
         "Must such constraints be inferred and enforced?"),
        ("Are off-topic/adversarial passages minimal?",
         "Is there substantial noise to down-weight?"),
        ("Does the query avoid numeric thresholds/comparatives?",
         "Is numeric reasoning required?"),
    ),
}
