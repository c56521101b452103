"""The record model: stages, label values and the vocabularies of trial logs."""

from __future__ import annotations

# Stage order is the semantics of every prefix and censoring rule.
STAGES = ["clone", "express", "soluble", "purify", "stable", "bind"]
STAGE_INDEX = {s: i for i, s in enumerate(STAGES)}
SUCCESS, FAIL, UNOBSERVED = 1, 0, -1
LABELS = [f"label_{s}" for s in STAGES]

RECORD_COLUMNS = [
    "record_id", "source", "sequence", "seq_len", "target_id", "center", "year", "organism",
    "is_designed", *LABELS, "evidence",
]
EXTRA_COLUMNS = ["cluster_key_seq", "exclusion_reason", "evidence_tier"]

# Trial status -> furthest stage it proves (None: proves none of the six).
STATUS_RULES: dict[str, str | None] = {
    "selected": None,
    "cloned": "clone",
    "expression tested": "clone",
    "expressed": "express",
    "biological assay": None,
    "biophysical analysis": None,
    "soluble": "soluble",
    "membrane protein solubilized": "soluble",
    "membrane protein solublized": "soluble",
    "purified": "purify",
    "mass spec verified": "purify",
    "crystallized": "purify",
    "diffraction-quality crystals": "purify",
    "diffraction": "purify",
    "native diffraction-data": "purify",
    "phasing diffraction-data": "purify",
    "crystal structure": "stable",
    "HSQC satisfactory": "purify",
    "NMR assigned": "stable",
    "NMR backbone resonances assigned": "stable",
    "NMR sidechain resonances assigned": "stable",
    "NMR structure": "stable",
    "in BMRB": "stable",
    "EM images": "purify",
    "EM reconstruction": "purify",
    "EM reconstruction in EMDB": "purify",
    "EM fitted model": "stable",
    "in PDB": "stable",
    "work stopped": None,
    "test target": None,
    "other": None,
}
# Statuses whose "stable" is inferred from a solved structure.
STRUCTURE_STATUSES = [
    "crystal structure", "NMR assigned", "NMR backbone resonances assigned",
    "NMR sidechain resonances assigned", "NMR structure", "in BMRB", "EM fitted model", "in PDB",
]
# Stop status -> failed stage (None: none of the six; EXCLUDE: no experiment).
EXCLUDE = "EXCLUDE"
STOP_RULES: dict[str, str | None] = {
    "cloning failed": "clone",
    "sequencing failed": "clone",
    "expression failed": "express",
    "membrane protein solubilization failed": "soluble",
    "purification failed": "purify",
    "biological assay failed": None,
    "biophysical analysis failed": None,
    "mass spec failed": None,
    "crystallization failed": None,
    "poor diffraction": None,
    "poor HSQC": None,
    "poor NMR": None,
    "poor EM images": None,
    "structure successful": None,
    "other": None,
    "duplicate target found": EXCLUDE,
    "internal duplicate target found": EXCLUDE,
    "TargetTrack duplicate target found": EXCLUDE,
    "PDB duplicate found": EXCLUDE,
}
EXCLUDED_STATUSES = ["test target"]
EXCLUDED_STOPS = [s for s, stage in STOP_RULES.items() if stage == EXCLUDE]
STOPPED = "work stopped"
POLICIES = ("keep_unobserved", "drop", "clone_zero")


def status_rules(structure_implies_stable: bool = True) -> dict[str, str | None]:
    """Status rules; the structure inference can be demoted from stable to purify."""
    if structure_implies_stable:
        return dict(STATUS_RULES)
    return {
        k: "purify" if k in STRUCTURE_STATUSES and v == "stable" else v
        for k, v in STATUS_RULES.items()
    }
