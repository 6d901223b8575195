"""Fixed values that results depend on, in natural order."""

# Skill aliases.
SKILL_ALIASES = {
    "py": "Python", "python": "Python", "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript",
    "k8s": "Kubernetes", "kubernetes": "Kubernetes", "golang": "Go", "go": "Go", "reactjs": "React", "react": "React", "nodejs": "Node.js", "node": "Node.js",
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "distributed systems": "Distributed Systems", "docker": "Docker", "aws": "AWS", "gcp": "GCP",
    "azure": "Azure", "sql": "SQL", "mysql": "MySQL", "mongodb": "MongoDB", "redis": "Redis",
}

# Skills that free text does not show by their name alone.
AMBIGUOUS_SKILLS = {"go"}

# Legal designators at the end of a company name, in the order in which they are removed.
LEGAL_SUFFIXES = [
    r",?\s+private\s+limited\.?$", r",?\s+pvt\.?\s+ltd\.?$", r",?\s+public\s+limited\s+company\.?$", r",?\s+pte\.?\s+ltd\.?$",
    r",?\s+l\.?\s*l\.?\s*c\.?$", r",?\s+l\.?\s*l\.?\s*p\.?$", r",?\s+p\.?\s*l\.?\s*c\.?$", r",?\s+incorporated\.?$", r",?\s+corporation\.?$",
    r",?\s+limited\.?$", r",?\s+inc\.?$", r",?\s+corp\.?$", r",?\s+ltd\.?$", r",?\s+gmbh\.?$", r",?\s+s\.?\s*a\.?$", r",?\s+a\.?\s*g\.?$",
]

# Cells that mean nothing.
NULL_LIKE = ["", "null", "none", "n/a", "na", "-"]

# Words of negation, where a scope ends, and what only looks like negation.
NEGATION_WINDOW = 8
NEGATION_CUES = {
    "no", "not", "never", "without", "neither", "nor", "lack", "lacks", "lacked", "lacking", "cannot", "can't", "cant", "doesn't", "doesnt", "didn't", "didnt",
    "hasn't", "hasnt", "haven't", "havent", "hadn't", "hadnt", "isn't", "isnt", "aren't", "arent", "wasn't", "wasnt", "weren't", "werent", "unable",
}
SCOPE_BREAKERS = {"but", "however", "yet", "although", "though", "except"}
PSEUDO_NEGATIONS = {
    ("not", "only"), ("not", "just"), ("not", "merely"), ("not", "bad"), ("not", "unfamiliar"), ("no", "concern"), ("no", "concerns"),
    ("no", "problem"), ("no", "problems"), ("no", "issue"), ("no", "issues"),
}
COPULAS = {"is", "are", "was", "were", "seems", "seemed", "appears", "appeared"}
ATTRIBUTES = {"ability", "background", "experience", "expertise", "familiarity", "knowledge", "proficiency", "skills"}

# Header aliases of the structured export, by logical field.
COLUMN_ALIASES = {
    "candidate_ref": ["candidate_ref", "candidate_id", "external_id", "applicant_id", "profile_id"],
    "full_name": ["name", "full_name", "candidate_name"],
    "emails": ["email", "emails", "primary_email"],
    "phones": ["phone", "phones", "mobile", "phone_number"],
    "experience.company": ["current_company", "company", "employer"],
    "experience.title": ["title", "current_title", "job_title", "role"],
    "experience.start": ["start_date", "experience_start", "experience_start_date", "employment_start", "employment_start_date", "job_start_date", "role_start_date", "started_at", "start"],
    "experience.end": ["end_date", "experience_end", "experience_end_date", "employment_end", "employment_end_date", "job_end_date", "role_end_date", "ended_at", "end"],
    "links.github": ["github", "github_url", "github_profile"],
    "application.applied_at": ["applied_at", "application_date", "applied_date", "submitted_at", "submission_date", "application_timestamp", "created_at"],
    "application.id": ["application_id", "application_ref", "submission_id", "application_number"],
}

# Confidence of a claim by source and kind.
CONFIDENCE = {
    "recruiter_csv": {"candidate_ref": 0.95, "emails": 0.95, "phones": 0.90, "full_name": 0.90, "experience.company": 0.85, "experience.title": 0.85, "experience.start": 0.90, "experience.end": 0.90, "links.github": 0.90, "application.applied_at": 0.90, "application.id": 0.95},
    "recruiter_notes": {"emails": 0.76, "phones": 0.72, "links.github": 0.72, "links.linkedin": 0.72, "links.portfolio": 0.72, "links.other": 0.72, "skills": 0.68},
    "ingestion_manifest": {"candidate_ref": 0.98},
    "github_profile": {"input_url": 0.71, "full_name": 0.64, "emails": 0.68, "html_url": 0.75, "blog": 0.64, "bio": 0.52, "company": 0.56},
}
# Confidence of a language by its repositories (five and more alike).
LANGUAGE_CONFIDENCE = [0.51, 0.54, 0.57, 0.61, 0.64]
# Priority of a source where claims are equal (others 99).
SOURCE_PRIORITY = {"recruiter_csv": 0, "ats_json": 1, "recruiter_notes": 2, "github_profile": 3}
# A phone shared by more records than this links none of them.
PHONE_BUCKET = 3
# Weights of overall confidence.
OVERALL = {"full_name": 0.15, "email": 0.25, "phone": 0.10, "github": 0.20, "skills": 0.15, "experience": 0.15}

# Dialling rules (country code, national trunk prefix, national number): a public numbering summary,
# not a full plan; of other countries only the length is checked.
PHONE_RULES = {
    "US": ("1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
    "CA": ("1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
    "IN": ("91", "0", r"[6-9]\d{9}"),
    "GB": ("44", "0", r"[1237]\d{9}"),
    "DE": ("49", "0", r"[1-9]\d{6,10}"),
    "FR": ("33", "0", r"[1-9]\d{8}"),
    "ES": ("34", "", r"[6-9]\d{8}"),
    "AU": ("61", "0", r"[2-478]\d{8}"),
    "SG": ("65", "", r"[3689]\d{7}"),
}
