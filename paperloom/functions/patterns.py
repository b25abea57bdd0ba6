"""Patterns, word lists and lookup tables that results depend on.

``(?U)`` gives Java's classes their Unicode meaning, ``(?i)`` ignores case.
"""

from __future__ import annotations

# --- fixed values: patterns of the exporter family ---

EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?){2,}\d{2,4}"
#: a number that stands by itself on its line and is written as a telephone's: with a plus or in parted groups
PHONE_WRITTEN = r"(?<![\p{L}\p{N}_@.+/-])(?=\+|[(\d]\d{1,3}\)?[ \t.-])(?:\+\d{1,3}[ \t.-]?)?(?:\(?\d{2,4}\)?[ \t.-]?){2,}\d{2,4}(?![\p{L}\p{N}_@])"
#: such a number of nine digits or more, which could be a key as well
PHONE_DIGITS = PHONE_WRITTEN.replace(r"(?=\+|[(\d]\d{1,3}\)?[ \t.-])", r"(?=\d{9})")
URL = r"(?U)(?:https?://)?(?:www\.)[\w.-]+\.[A-Za-z]{2,}\S*"
MONTHS = ("janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre|"
          "january|february|march|april|may|june|july|august|september|october|november|december")
DATE = rf"(?iU)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}|(?:{MONTHS})\s+\d{{4}})\b"
_DATE = DATE.removeprefix("(?iU)")
DATE_RANGE = rf"(?iU){_DATE}\s*(?:-|–|—|to|à|au|jusqu.?à)\s*(?:{_DATE}|en poste actuellement|present|currently)"
MONEY = r"(?i)(?:€|\$|£)?\s*\d[\d\s,.]*(?:€|\$|£|EUR|USD|GBP|TND|MAD|DZD)?"
#: the value extractor tries bare years last
CANDIDATE_DATE = rf"(?iU)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|(?:{MONTHS})\s+\d{{4}}|\d{{4}})\b"
CANDIDATE_URL = r"(?iU)(?:https?://)?(?:www\.)[\w.-]+\.[A-Za-z]{2,}\S*"
KEY_VALUE = r"^\s*([^:]{2,80})\s*:\s*(.{1,300})\s*$"
INVOICE_REFERENCE = r"(?i)(?:invoice|facture|ref(?:erence)?|n[°o.]*)\s*[:#-]?\s*([A-Za-z0-9][A-Za-z0-9._/-]{2,})"
REFERENCE_WORDS = ("invoice", "facture", "reference", "référence", "ref", "n°", "no.")
STREET = r"(?i)\b(st\.|street|rue|avenue|av\.|bd|boulevard)\b"
CITY = r"(?i)\b(city|ville|paris|toulouse|lyon|any city)\b"
LOCATION = r"(?i)\b(paris|toulouse|stockholm|amsterdam|city|france|suède|suede)\b"
ACCOUNT = r"\b\d{4}\s+\d{4}\s+\d{4}"
ACCOUNT_RUN = r"\b[\d ]{14,}\b"
COMPANY_WORDS = ("sarl", "ltd", "inc", "company", "naudin")

# --- fixed values: patterns of the core family ---

CORE_PHONE = r"(?:\+?\d[\d\s().-]{6,}\d)"
CORE_URL = r"(?:https?://)?(?:www\.)?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[^\s]*)?"
_MON = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
CORE_DATE_RANGE = rf"(?i)(?:{_MON}\s+)?\d{{4}}\s*(?:-|to|–|—)\s*(?:{_MON}\s+)?(?:\d{{4}}|Present|Current|Ongoing)"
CORE_DATE = rf"(?i)\b(?:\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|{_MON}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MON}\s+\d{{4}})\b"
BULLET = r"^\s*(?:[-*]|•|[0-9]+[.)])\s*"

# --- fixed values: headings and sections ---

HEADINGS = ("profile", "summary", "experience", "work experience", "education", "formation", "skills", "competences", "languages", "langues",
            "certifications", "projects", "projets", "hobbies", "centres d interet", "payment", "paiement")
SECTION_WORDS = ("summary", "profile", "profil", "experience", "experiences", "expérience", "work experience", "education", "formation", "skills",
                 "compétences", "competences", "languages", "langues", "contact", "strengths", "hobbies")
SECTION_ALIASES = {
    "summary": ("summary", "profile", "objective", "about me", "professional summary", "profil"),
    "experience": ("experience", "work experience", "employment", "work history", "professional experience", "expérience", "experiences"),
    "education": ("education", "academic", "formation", "academic background"),
    "skills": ("skills", "technical skills", "professional skills", "competences", "compétences", "competencies", "tools"),
    "languages": ("languages", "language", "langues", "langue"),
    "contact": ("contact", "contact information", "details", "coordonnées", "personal details"),
    "strengths": ("strengths", "achievements", "highlights"),
    "hobbies": ("hobbies", "interests"),
    "invoice_items": ("description", "item", "items", "services", "qty", "quantity"),
    "totals": ("subtotal", "tax", "vat", "total", "amount due", "balance due"),
    "legal_clause": ("whereas", "definitions", "term", "confidentiality", "obligations", "governing law"),
}
SECTION_TYPES = {
    "summary": "summary_section", "experience": "experience_section", "education": "education_section", "skills": "skills_section",
    "languages": "languages_section", "contact": "contact_section", "strengths": "strengths_section", "hobbies": "hobbies_section",
    "invoice_items": "table_section", "totals": "totals_section", "legal_clause": "legal_clause",
}
REGION_TYPES = {"title": "heading", "text": "paragraph", "table": "table_section", "figure": "figure", "list": "list_item", "header": "heading"}

# --- fixed values: document types, in the order that settles ties ---

INVOICE_MARKERS = ("invoice", "facture", "total", "subtotal", "vat", "tax", "amount due", "balance due", "payment", "فاتورة", "المبلغ", "الضريبة")
CV_MARKERS = ("experience", "education", "skills", "curriculum vitae", "resume", "expérience", "formation", "compétences", "خبرة", "مهارات", "تعليم")
LEGAL_MARKERS = ("agreement", "contract", "parties", "whereas", "obligations", "governing law", "contrat", "عقد", "اتفاقية")
TYPE_KEYWORDS = {
    "cv": (*sorted(CV_MARKERS), "experience", "education", "skills", "work history", "curriculum vitae", "resume", "profile", "expérience", "formation", "compétences", "خبرة", "مهارات", "تعليم", "السيرة الذاتية"),
    "invoice": (*sorted(INVOICE_MARKERS), "invoice", "total", "amount due", "payment", "subtotal", "vat", "tax", "facture", "montant", "tva", "devis", "فاتورة", "المبلغ الإجمالي", "الدفع"),
    "contract": (*sorted(LEGAL_MARKERS), "agreement", "terms and conditions", "signed", "party", "parties", "contract", "contrat", "signature", "عقد", "اتفاقية", "الطرف"),
    "id_card": ("national id", "identity card", "date of birth", "nationality", "carte d'identité", "cin", "رقم الهوية", "تاريخ الميلاد", "الجنسية"),
    "form": ("please fill", "checkbox", "signature required", "form", "application", "formulaire", "استمارة", "يرجى تعبئة"),
    "signature": ("signature", "signed by", "authorized by", "signatory", "signature requise", "signé par", "approved by", "توقيع", "الإمضاء", "ختم"),
    "legal": (*sorted(LEGAL_MARKERS), "court", "article", "regulation", "law", "judgment", "tribunal", "loi", "المحكمة", "قانون", "مرسوم"),
    "administrative": ("ministry", "department", "official document", "reference number", "certificate", "ministère", "attestation", "وزارة", "إدارة", "وثيقة رسمية"),
}

# --- fixed values: language hints ---

LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]"
ACCENTED = "[À-ÖØ-öø-ÿ]"
ARABIC = "[؀-ۿ]"
CJK = "[一-鿿　-〿]"
LANGUAGE_HINTS = {
    "ar": (0.24, ("فاتورة", "المبلغ", "الدفع", "خبرة", "مهارات", "تعليم", "الهاتف", "البريد")),
    "fr": (0.18, ("à", "â", "ç", "é", "è", "ê", "ë", "î", "ï", "ô", "ù", "û", "ü", "œ", "formation", "expérience", "compétences", "facture", "montant", "paiement", "téléphone", "adresse", "courriel")),
    "en": (0.16, ("invoice", "total", "payment", "amount", "experience", "education", "skills", "profile", "phone", "email", "address")),
    "zh": (0.20, ("发票", "简历", "教育", "经验", "技能", "电话", "邮箱", "地址", "总额")),
}
RTL = ("ar", "fa", "he", "ur", "yi")

# --- fixed values: names of fields ---

FIELD_SYNONYMS = {
    "e_mail": "email", "mail": "email", "telephone": "phone", "tel": "phone", "tva": "tax", "vat": "tax", "sub_total": "subtotal", "sous_total": "subtotal",
    "grand_total": "total", "amount_due": "total", "montant_total": "total", "invoice_no": "invoice_number", "invoice_number": "invoice_number", "facture": "invoice_number",
}
FIELD_LABELS = {
    "personal_info.name": "Full Name", "personal_info.contact.phone": "Phone", "personal_info.contact.email": "Email", "personal_info.contact.urls": "URLs",
    "personal_info.hobbies": "Hobbies", "education.formation": "Education", "work_experience": "Work Experience", "skills": "Skills", "languages": "Languages",
    "certifications": "Certifications", "projects": "Projects", "vendor.name": "Vendor Name", "vendor.attention_of": "Attention To", "client.phone": "Client Phone",
    "client.email": "Client Email", "client.address": "Client Address", "items": "Line Items", "totals.subtotal": "Subtotal", "totals.tax": "Tax / VAT", "totals.total": "Total",
    "payment.method": "Payment Method", "payment.conditions": "Payment Terms", "payment.account_number": "Account Number", "payment.due_date": "Due Date",
    "title": "Document Title", "contacts": "Contact Information", "dates": "Dates", "amounts": "Amounts", "key_values": "Key-Value Fields", "tables": "Tables", "sections": "Sections",
}
ACTIVE_STATUSES = ("queued", "ocr_running", "ai_running")

# --- fixed values: what marks a line as important, and a type as another one ---

POINT_EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.\w+"
POINT_WORDS = "(total|invoice|facture|experience|education|contract|agreement|date)"
INVOICE_OVERRIDE = r"(?U)\b(invoice|facture|total|vat|tva|amount|montant)\b"
CV_OVERRIDE = r"(?U)\b(experience|expérience|education|formation|skills|compétences)\b"

# --- fixed values: titles of entries ---

ROLE_WORDS = ("designer", "engineer", "developer", "manager", "director", "consultant", "analyst", "specialist", "assistant", "officer", "architect", "researcher", "intern", "lead", "head")
ACTION_STARTERS = ("led", "conducted", "collaborated", "created", "built", "managed", "reduced", "increased", "designed")
DEGREES = r"(?U)\b(bachelor|master|science|degree|licence|diploma|phd|doctor|university)\b"
LEGAL_PARTY_MARKS = ("party a", "party b", " by and between", "between:")
