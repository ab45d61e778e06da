"""Schemas, constants and built-in lookup tables of the moderation data model."""

from __future__ import annotations

VERSION = "1.2.0"
SOURCE = "struct<kind:string,ref:string,ref_digest:string,media_type:string>"
JOB = f"job_id string, source {SOURCE}, workflows array<string>, dedup_threshold int, metadata string, submitted_at timestamp"
MANIFEST = "id string, kind string, ref string, media_type string, workflows array<string>, dedup_threshold int, metadata string"
CATEGORY = "struct<category:string,provider_label:string,score:double,score_origin:string,threshold:double,flagged:boolean>"
FRAME = f"struct<timestamp_sec:double,status:string,error:string,categories:array<{CATEGORY}>>"
OVERALL = "struct<verdict:string,flagged:boolean,top_category:string,max_score:double,confidence:double>"
RESULT = f"struct<schema_version:string,provider:string,model_version:string,media_type:string,asset_id:string,frames:array<{FRAME}>,overall:{OVERALL}>"
ENVELOPE = f"job_id string, source {SOURCE}, model_id struct<adapter:string,model_version:string,config_hash:string>, result {RESULT}, error string, metadata string, started_at timestamp, finished_at timestamp"
AUDIT = "chain_id long, seq long, timestamp string, prev_hash string, payload map<string,string>, entry_hash string, signature string"
HEADS_OF_CHAINS = "chain_id long, seq long, entry_hash string, log_version long"
SEVERITY_RESPONSE = "categoriesAnalysis array<struct<category:string,severity:int>>"
LIKELIHOOD_RESPONSE = "adult string, spoof string, medical string, violence string, racy string"
HEADS_RESPONSE = "status array<struct<response:struct<output:array<struct<time:double,classes:array<struct<class:string,score:double>>>>>>>"
LOGPROB_RESPONSE = "choices array<struct<logprobs:struct<content:array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>>>>"

#: Categories, score origins, extensions, caps and lookup tables.
CATEGORIES = ("SEXUAL", "SUGGESTIVE_RACY", "VIOLENCE", "GORE_GRAPHIC", "WEAPONS", "SELF_HARM", "HATE", "DRUGS", "ALCOHOL_TOBACCO", "GAMBLING", "OFFENSIVE_GESTURE", "MEDICAL", "SPOOF", "ANIMATED_SYNTHETIC", "OTHER")
PROVENANCE = ("MEDICAL", "SPOOF", "ANIMATED_SYNTHETIC")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v", ".mpg", ".mpeg", ".ts")
SEVERITY_CATEGORIES = {"Hate": "HATE", "Sexual": "SEXUAL", "Violence": "VIOLENCE", "SelfHarm": "SELF_HARM"}
LIKELIHOOD_CATEGORIES = {"adult": "SEXUAL", "spoof": "SPOOF", "medical": "MEDICAL", "violence": "VIOLENCE", "racy": "SUGGESTIVE_RACY"}
LIKELIHOOD_SCORES = {"VERY_UNLIKELY": 0.0, "UNLIKELY": 0.25, "POSSIBLE": 0.5, "LIKELY": 0.75, "VERY_LIKELY": 1.0}
HEADS = {
    "SEXUAL": "general_nsfw yes_sexual_activity yes_realistic_nsfw yes_sexual_intent yes_undressed yes_female_nudity yes_male_nudity yes_genitals yes_breast yes_sex_toy animal_genitalia_and_human",
    "SUGGESTIVE_RACY": "general_suggestive yes_female_underwear yes_male_underwear yes_bra yes_panties yes_negligee yes_cleavage yes_bulge yes_butt kissing licking",
    "GORE_GRAPHIC": "very_bloody a_little_bloody other_blood human_corpse animated_corpse",
    "VIOLENCE": "yes_fight yes_animal_abuse",
    "SELF_HARM": "hanging noose yes_self_harm yes_emaciated_body",
    "HATE": "yes_nazi yes_kkk yes_confederate yes_terrorist",
    "OFFENSIVE_GESTURE": "yes_middle_finger",
    "DRUGS": "illicit_injectables yes_pills yes_marijuana",
    "ALCOHOL_TOBACCO": "yes_alcohol yes_drinking_alcohol animated_alcohol yes_smoking",
    "GAMBLING": "yes_gambling",
    "WEAPONS": "gun_in_hand gun_not_in_hand animated_gun knife_in_hand knife_not_in_hand",
    "OTHER": "culinary_knife_in_hand culinary_knife_not_in_hand",
    "ANIMATED_SYNTHETIC": "animated hybrid natural yes_drawing animated_animal_genitalia",
    "MEDICAL": "medical_injectables",
}
CLASS_MAP = [(label, category) for category, labels in HEADS.items() for label in labels.split()]
POLICIES = {"dangerous": "WEAPONS", "sexual": "SEXUAL", "violence": "VIOLENCE"}
IMAGE_CAPS = {"severity": 4 << 20, "likelihood": 20 << 20, "heads": 20 << 20, "logprob": 0}
DEFAULT_THRESHOLDS = [("default", 0.5, 0.8), ("SEXUAL", 0.4, 0.7)]
