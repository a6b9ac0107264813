"""Types, schemas and fixed values of the engine. Positions are code points, ends exclusive."""

from __future__ import annotations

ENTITY_TYPES = ("PERSON_NAME", "DATE_OF_BIRTH", "OTHER_DATE", "AGE", "ADDRESS", "PHONE", "EMAIL", "URL", "ID_NUMBER", "ORGANIZATION", "PROFESSION", "OTHER_PII")
TRANSFORMATIONS = ("TYPE_MASK", "CONSISTENT_TAG", "GENERALIZE", "REMOVE", "PRESERVE")
STATUSES = ("REDACTED", "GENERALIZED", "TAGGED", "PRESERVED")
LANGUAGES = ("de", "en", "fr", "es")

METADATA = ("rule_id", "subtype", "user_term", "role", "grounding", "tag_group", "supporting_detectors", "overridden", "preserved_by_term", "user_manual")
METADATA_DDL = f"struct<{','.join(f'{k}:string' for k in METADATA)}>"
SPAN_DDL = f"struct<start:int,end:int,text:string,entity_type:string,confidence:double,detector:string,ordinal:int,metadata:{METADATA_DDL}>"
APPLIED_DDL = SPAN_DDL[:-1] + ",transformation:string,replacement:string,status:string>"
OVERRIDE_DDL = "struct<start:int,end:int,text:string,transformation:string,entity_type:string>"
MENTION_DDL = "struct<text:string,entity_type:string,role:string>"
NOTICE_DDL = "struct<code:string,message:string,params:map<string,string>>"
WARNING_DDL = "struct<code:string,category:string,severity:string,start:int,end:int,entity_type:string,message:string>"
LINE_DDL = "struct<text:string,box:struct<x1:int,y1:int,x2:int,y2:int>>"

# What happens to each type unless a policy says otherwise.
DEFAULT_POLICY = {
    "PERSON_NAME": "CONSISTENT_TAG",
    "DATE_OF_BIRTH": "TYPE_MASK",
    "OTHER_DATE": "PRESERVE",
    "AGE": "TYPE_MASK",
    "ADDRESS": "TYPE_MASK",
    "PHONE": "TYPE_MASK",
    "EMAIL": "TYPE_MASK",
    "URL": "TYPE_MASK",
    "ID_NUMBER": "TYPE_MASK",
    "ORGANIZATION": "TYPE_MASK",
    "PROFESSION": "TYPE_MASK",
    "OTHER_PII": "TYPE_MASK",
}

# Placeholders in the order of ENTITY_TYPES, the mark of removed text, the stem of numbered tags, the export's name.
PLACEHOLDERS = {
    "de": ("[PERSON] [GEBURTSDATUM] [DATUM] [ALTER] [ADRESSE] [TELEFON] [E-MAIL] [URL] [ID] [ORGANISATION] [BERUF] [PII]", "[GESCHWÄRZT]", "PERSON", "anonymisiert"),
    "en": ("[PERSON] [DATE_OF_BIRTH] [DATE] [AGE] [ADDRESS] [PHONE] [E-MAIL] [URL] [ID] [ORGANIZATION] [PROFESSION] [PII]", "[REDACTED]", "PERSON", "anonymized"),
    "fr": ("[PERSONNE] [DATE_DE_NAISSANCE] [DATE] [AGE] [ADRESSE] [TELEPHONE] [E-MAIL] [URL] [ID] [ORGANISATION] [PROFESSION] [PII]", "[CAVIARDE]", "PERSONNE", "anonymise"),
    "es": ("[PERSONA] [FECHA_DE_NACIMIENTO] [FECHA] [EDAD] [DIRECCION] [TELEFONO] [CORREO] [URL] [ID] [ORGANIZACION] [PROFESION] [PII]", "[OCULTADO]", "PERSONA", "anonimizado"),
}

# Labels of annotated corpora.
LABELS = {
    "patientname": "PERSON_NAME",
    "firstname": "PERSON_NAME",
    "lastname": "PERSON_NAME",
    "name": "PERSON_NAME",
    "patientgender": "OTHER_PII",
    "sex": "OTHER_PII",
    "patientid": "ID_NUMBER",
    "age": "AGE",
    "dateofbirth": "DATE_OF_BIRTH",
}

# Characters that the character metrics leave out.
NOT_SCORED = " ,.!?:;-()\"'\n\t\r"

# Messages of notices and warnings, by code.
MESSAGES = {
    "docx_comments": "The document contains comments, which are not extracted.",
    "docx_tracked_changes": "The document contains tracked changes; inserted text may be incomplete.",
    "docx_tracked_deletions": "The document contains tracked deletions, which are not extracted.",
    "docx_text_boxes": "The document contains text boxes, which are not extracted.",
    "pdf_no_page_mapping": "Page mapping is not available for docling-serve extraction.",
    "pdf_docling_fallback": "docling-serve failed ({reason}); used local extraction.",
    "ocr_recognition_errors": "Text was produced by OCR; recognition errors are possible.",
    "llm_mention_not_located": "The LLM reported a {entity_type} mention that could not be located in the source text; please review the document manually.",
    "invalid_span_rejected": "Rejected invalid span from detector '{detector}' (offset mismatch).",
    "override_not_matched": "An override did not match any detected span and was ignored.",
    "manual_selection_ignored": "A manual selection no longer matches the source text and was ignored.",
    "pdf_preserve_not_honoured": "{count} passage(s) you kept also occur elsewhere in redacted form. The redacted PDF blacks out every occurrence of a redacted text, so these stay covered there even though the text export keeps them.",
    "residual_identifier": "Redacted {entity_type} content appears to remain in the output.",
    "revalidation_hit": "A rule detector still finds a possible {entity_type} in the output.",
    "labelled_field": "A labelled field appears to be followed by non-redacted content.",
    "llm_recheck_failed": "The LLM re-check could not be performed; please review the result manually.",
    "llm_recheck_remaining": "The LLM re-check found a possible remaining {entity_type} in the output.",
    "llm_recheck_unlocated": "The LLM re-check reported possible remaining PII that could not be located.",
    "llm_recheck_skipped": "The LLM re-check was not repeated for this adjusted result.",
    "recheck_risk": "The LLM re-check rates the remaining risk of re-identification as {risk}.",
}


class DetectorUnavailable(RuntimeError):
    """A configured detector can't run; nothing is processed with fewer detectors than asked for."""


def language(code: str | None) -> str:
    return code if code in LANGUAGES else "de"


def masks(code: str | None) -> dict[str, str]:
    return dict(zip(ENTITY_TYPES, PLACEHOLDERS[language(code)][0].split(" ")))


def merged_policy(policy: dict[str, str] | None) -> dict[str, str]:
    """The default policy overlaid with a partial one; unknown names are refused."""
    for kind, what in (policy or {}).items():
        if kind not in ENTITY_TYPES or what not in TRANSFORMATIONS:
            raise ValueError(f"no such policy: {kind} -> {what}")
    return DEFAULT_POLICY | (policy or {})


def policy_deviations(policy: dict[str, str] | None) -> dict[str, str] | None:
    """The entries that differ from the default; None if none does."""
    return {k: v for k, v in (policy or {}).items() if DEFAULT_POLICY.get(k) != v} or None
