"""Dimension tables of the legal domain."""

from __future__ import annotations

import unicodedata

# Words without weight in entity matching.
STOP_WORDS = (
    "là", "gì", "của", "trong", "và", "các", "có", "được", "để", "cho", "về", "với", "khi", "này", "theo", "hoặc", "thì", "như", "nếu", "tại",
    "một", "những", "bởi", "mà", "đã", "đang", "sẽ", "phải", "không",
)
# Words that are no search keywords.
KEYWORD_STOP_WORDS = ("là", "gì", "của", "trong", "và", "các", "có", "được", "để", "cho", "về", "với", "khi", "này", "theo")

# Weights of relation types in personalised PageRank by intent; a type without entry weighs UNKNOWN_RELATION.
INTENT_RELATION_WEIGHTS = {
    "concept": {"ĐỊNH_NGHĨA_LÀ": 1.0, "DEFINED_AS": 1.0, "LÀ_MỘT": 0.95, "IS_A": 0.95, "BAO_GỒM": 0.85, "INCLUDES": 0.85, "LIÊN_QUAN_ĐẾN": 0.5, "RELATED_TO": 0.5, "THAM_CHIẾU": 0.4, "REFERENCES": 0.4},
    "procedure": {"YÊU_CẦU": 1.0, "REQUIRES": 1.0, "XẢY_RA_TRƯỚC": 0.95, "PRECEDES": 0.95, "XẢY_RA_SAU": 0.9, "FOLLOWS": 0.9, "ĐIỀU_KIỆN_CHO": 0.85, "CONDITION_FOR": 0.85},
    "right": {"CÓ_QUYỀN": 1.0, "HAS_AUTHORITY_OVER": 0.95, "CÓ_THẨM_QUYỀN": 0.95, "ỦY_QUYỀN_CHO": 0.85, "DELEGATES_TO": 0.85, "ÁP_DỤNG_CHO": 0.7, "APPLIES_TO": 0.7},
    "obligation": {"CÓ_NGHĨA_VỤ": 1.0, "CHỊU_TRÁCH_NHIỆM": 0.95, "RESPONSIBLE_FOR": 0.95, "YÊU_CẦU": 0.9, "REQUIRES": 0.9, "BỊ_PHẠT": 0.7, "HAS_PENALTY": 0.7},
    "consequence": {"BỊ_PHẠT": 1.0, "HAS_PENALTY": 1.0, "CÓ_CHẾ_TÀI": 0.95, "VI_PHẠM": 0.85, "RESULTS_IN": 0.9},
    "general": {"RELATED_TO": 0.5, "LIÊN_QUAN_ĐẾN": 0.5, "REFERENCES": 0.4, "THAM_CHIẾU": 0.4, "REQUIRES": 0.5, "YÊU_CẦU": 0.5},
}
UNKNOWN_RELATION = 0.3
SYMMETRIC_RELATIONS = ("RELATED_TO", "LIÊN_QUAN_ĐẾN", "SYNONYM", "ĐỒNG_NGHĨA_VỚI", "CONTRADICTS", "MÂU_THUẪN_VỚI")

# The intents in the order they are tried, with the words that show them; "reference" is an article number.
INTENT_WORDS = {
    "penalty": ("phạt", "hình phạt", "mức phạt", "xử phạt"),
    "definition": ("là gì", "định nghĩa", "nghĩa là"),
    "procedure": ("thủ tục", "quy trình", "hồ sơ"),
    "requirement": ("điều kiện", "yêu cầu", "cần phải"),
}
# Query types in the order they are tried, with patterns.
QUERY_TYPE_PATTERNS = {
    "article_lookup": (r"điều\s+\d+\s*(quy\s+định|nói|là)", r"theo\s+điều\s+\d+", r"nội\s+dung\s+điều\s+\d+", r"điều\s+\d+\s+luật", r"khoản\s+\d+\s+điều\s+\d+"),
    "compare_regulations": (r"so\s+sánh", r"khác\s+(biệt|nhau)", r"giống\s+nhau", r"sự\s+khác\s+biệt", r"điểm\s+mới", r"thay\s+đổi\s+gì"),
    "timeline_history": (r"lịch\s+sử\s+.*sửa\s+đổi", r"quá\s+trình\s+.*thay\s+đổi", r"từ\s+.*đến\s+nay", r"trước\s+đây", r"sau\s+khi\s+sửa\s+đổi", r"hiệu\s+lực\s+từ"),
    "case_law_lookup": (r"án\s+lệ", r"bản\s+án", r"quyết\s+định\s+.*tòa", r"tiền\s+lệ\s+pháp", r"vụ\s+án\s+.*liên\s+quan"),
    "guidance_document": (r"nghị\s+định\s+.*hướng\s+dẫn", r"thông\s+tư\s+.*hướng\s+dẫn", r"văn\s+bản\s+.*hướng\s+dẫn", r"hướng\s+dẫn\s+thi\s+hành", r"quy\s+định\s+chi\s+tiết"),
    "situation_analysis": (r"vi\s+phạm\s+.*điều", r"hành\s+vi\s+.*vi\s+phạm", r"trường\s+hợp\s+.*xử\s+lý", r"có\s+.*vi\s+phạm", r"bị\s+(xử\s+)?phạt", r"hậu\s+quả\s+pháp\s+lý"),
}
# Fixed values: (query type, method, alpha, hops, reasoning, temporal).
STRATEGIES = (
    ("article_lookup", "Vector + Light Graph", 0.3, 1, False, False),
    ("guidance_document", "Graph Traversal Multi-hop", 0.8, 3, False, False),
    ("situation_analysis", "Hybrid + Reasoning", 0.7, 3, True, False),
    ("compare_regulations", "Multi-doc Comparison", 0.6, 2, False, False),
    ("case_law_lookup", "Case + Article Reference", 0.5, 2, False, False),
    ("timeline_history", "Temporal Retrieval", 0.4, 2, False, True),
    ("general", "Hybrid Search", 0.5, 2, False, False),
)
# Abbreviations written out in questions.
QUERY_ABBREVIATIONS = {
    "CTCP": "Công ty cổ phần", "TNHH": "Trách nhiệm hữu hạn", "TNHH 1TV": "Trách nhiệm hữu hạn một thành viên", "TNHH 2TV": "Trách nhiệm hữu hạn hai thành viên",
    "1TV": "một thành viên", "2TV": "hai thành viên trở lên", "DNTN": "Doanh nghiệp tư nhân", "HKD": "Hộ kinh doanh", "HĐQT": "Hội đồng quản trị",
    "HĐTV": "Hội đồng thành viên", "TGĐ": "Tổng giám đốc", "GĐ": "Giám đốc", "ĐKKD": "Đăng ký kinh doanh", "VĐL": "Vốn điều lệ", "MST": "Mã số thuế",
    "DN": "Doanh nghiệp", "cty": "công ty",
}
# Everyday words and the terms of the law for them.
QUERY_SYNONYMS = {
    "lập công ty": ("thành lập doanh nghiệp", "đăng ký doanh nghiệp"),
    "mở công ty": ("thành lập doanh nghiệp", "đăng ký doanh nghiệp"),
    "đóng cửa": ("giải thể doanh nghiệp", "chấm dứt hoạt động"),
    "chuyển đổi loại hình": ("chuyển đổi doanh nghiệp", "tổ chức lại doanh nghiệp"),
    "tăng vốn": ("tăng vốn điều lệ",),
    "giảm vốn": ("giảm vốn điều lệ",),
    "góp vốn": ("góp vốn điều lệ",),
    "góp thêm vốn": ("góp vốn bổ sung", "tăng vốn góp"),
    "thay đổi vốn": ("thay đổi vốn điều lệ", "tăng vốn điều lệ", "giảm vốn điều lệ"),
    "bán cổ phần": ("chuyển nhượng cổ phần",),
    "đổi đại diện": ("thay đổi người đại diện theo pháp luật",),
    "tăng vốn tnhh": ("tăng vốn điều lệ công ty TNHH",),
}
# Topics, the words that show them, and the hints they give.
TOPIC_HINTS = (
    (("chuyển đổi", "chuyển từ", "sang tnhh", "sang ctcp"), ("chuyển đổi loại hình", "tổ chức lại doanh nghiệp")),
    (("giải thể", "đóng cửa", "chấm dứt"), ("giải thể doanh nghiệp", "chấm dứt hoạt động")),
    (("tạm ngừng", "tạm ngưng", "tạm nghỉ"), ("tạm ngừng kinh doanh", "ngừng hoạt động tạm thời")),
    (("tăng vốn", "giảm vốn"), ("tăng vốn điều lệ", "giảm vốn điều lệ")),
)

# Classes of the default ontology with their parents and labels.
ONTOLOGY_CLASSES = (
    ("Thing", None, None), ("Organization", "Thing", "tổ chức"), ("Document", "Thing", "văn bản"), ("LegalConcept", "Thing", None), ("Company", "Organization", "công ty"),
    ("JointStockCompany", "Company", "công ty cổ phần"), ("LimitedLiabilityCompany", "Company", "công ty trách nhiệm hữu hạn"),
    ("SingleMemberLLC", "LimitedLiabilityCompany", "công ty TNHH một thành viên"), ("MultiMemberLLC", "LimitedLiabilityCompany", "công ty TNHH hai thành viên"),
    ("PrivateEnterprise", "Company", "doanh nghiệp tư nhân"), ("Partnership", "Company", "công ty hợp danh"), ("HouseholdBusiness", "Organization", "hộ kinh doanh"),
    ("Law", "Document", "luật"), ("Decree", "Document", "nghị định"), ("Circular", "Document", "thông tư"), ("Decision", "Document", "quyết định"),
    ("Resolution", "Document", "nghị quyết"), ("CharterCapital", "LegalConcept", "vốn điều lệ"), ("LegalRepresentative", "LegalConcept", "người đại diện theo pháp luật"),
    ("Shareholder", "LegalConcept", "cổ đông"), ("Member", "LegalConcept", "thành viên"), ("BoardOfDirectors", "LegalConcept", "hội đồng quản trị"),
    ("MembersCouncil", "LegalConcept", "hội đồng thành viên"),
)
# Abbreviations of class names.
ONTOLOGY_ABBREVIATIONS = {
    "ctcp": "JointStockCompany", "cty cp": "JointStockCompany", "tnhh": "LimitedLiabilityCompany", "cty tnhh": "LimitedLiabilityCompany", "tnhh 1tv": "SingleMemberLLC",
    "tnhh mtv": "SingleMemberLLC", "tnhh 2tv": "MultiMemberLLC", "dntn": "PrivateEnterprise", "hkd": "HouseholdBusiness", "nđ": "Decree", "nd": "Decree",
    "tt": "Circular", "qđ": "Decision", "qd": "Decision", "nq": "Resolution", "vđl": "CharterCapital", "nddpl": "LegalRepresentative", "hđqt": "BoardOfDirectors",
    "hdqt": "BoardOfDirectors", "hđtv": "MembersCouncil",
}

# Document types and the ways they are written.
DOC_TYPES = {
    "luat": ("luật", "luat", "bộ luật", "bo luat"),
    "nghi_dinh": ("nghị định", "nghi dinh", "nđ", "nd"),
    "thong_tu": ("thông tư", "thong tu", "tt"),
    "quyet_dinh": ("quyết định", "quyet dinh", "qđ", "qd"),
    "nghi_quyet": ("nghị quyết", "nghi quyet", "nq"),
}
DOC_REFERENCE = (
    r"(luật|nghị\s*định|thông\s*tư|quyết\s*định|nghị\s*quyết|nđ|tt|qđ|nq|luat|nghi\s*dinh|thong\s*tu|quyet\s*dinh|nghi\s*quyet)"
    r"[\s\-]*(\d+)(?:[/\-](\d{4}))?(?:[/\-]([a-zđ\-]+))?"
)

# Predicates of extraction and their relation types, Vietnamese with accents; forms without accents follow by rule.
RELATION_TYPES = {
    "YÊU_CẦU": "REQUIRES", "THUỘC_VỀ": "PART_OF", "CÓ_THẨM_QUYỀN": "HAS_AUTHORITY_OVER", "THAM_CHIẾU": "REFERENCES", "ĐỊNH_NGHĨA": "DEFINED_AS",
    "ĐỊNH_NGHĨA_LÀ": "DEFINED_AS", "ÁP_DỤNG": "APPLIES_TO", "ÁP_DỤNG_CHO": "APPLIES_TO", "XỬ_PHẠT": "HAS_PENALTY", "BỊ_PHẠT": "HAS_PENALTY",
    "THỜI_HẠN": "CONDITION_FOR", "TỶ_LỆ": "INCLUDES", "NGOẠI_TRỪ": "EXCLUDES", "BAO_GỒM": "INCLUDES", "SỬA_ĐỔI": "AMENDS", "THAY_THẾ": "SUPERSEDES",
    "BÃI_BỎ": "REPEALS", "HƯỚNG_DẪN": "IMPLEMENTS", "CÓ_QUYỀN": "AUTHORIZED_BY", "CÓ_NGHĨA_VỤ": "RESPONSIBLE_FOR", "CHỊU_TRÁCH_NHIỆM": "RESPONSIBLE_FOR",
    "ỦY_QUYỀN_CHO": "DELEGATES_TO", "LÀ_MỘT": "IS_A", "LIÊN_QUAN_ĐẾN": "RELATED_TO", "LIÊN_QUAN": "RELATED_TO", "QUY_ĐỊNH_VỀ": "REGULATES",
    "XẢY_RA_TRƯỚC": "PRECEDES", "XẢY_RA_SAU": "FOLLOWS", "MÂU_THUẪN_VỚI": "CONTRADICTS", "ĐỒNG_NGHĨA_VỚI": "SYNONYM", "NGHIÊM_CẤM": "EXCLUDES",
    "LOẠI_TRỪ": "EXCLUDES", "VI_PHẠM": "CONTRADICTS", "BẢO_HỘ": "AUTHORIZED_BY", "ĐIỀU_KIỆN_CHO": "CONDITION_FOR", "ĐƯỢC_YÊU_CẦU_BỞI": "REQUIRED_BY",
    "KẾT_QUẢ": "RESULTS_IN", "THỰC_HIỆN_BỞI": "PERFORMED_BY", "CHỨA": "CONTAINS", "ĐỊNH_NGHĨA_TẠI": "DEFINED_IN", "ĐỀ_CẬP_TẠI": "MENTIONED_IN",
}
DEFAULT_RELATION_TYPE = "RELATED_TO"
# Types of entities in Vietnamese and English; forms without accents follow by rule.
ENTITY_TYPES = {
    "TỔ_CHỨC": "ORGANIZATION", "VAI_TRÒ": "PERSON_ROLE", "THUẬT_NGỮ": "LEGAL_TERM", "THAM_CHIẾU": "LEGAL_REFERENCE", "TIỀN_TỆ": "MONETARY", "TỶ_LỆ": "PERCENTAGE",
    "THỜI_HẠN": "DURATION", "ĐỊA_ĐIỂM": "LOCATION", "ĐIỀU_KIỆN": "CONDITION", "HÀNH_VI": "ACTION", "CHẾ_TÀI": "PENALTY",
}
DEFAULT_ENTITY_TYPE = "LEGAL_TERM"
# Kinds of documents as they are written on them, and their names in ids.
DOCUMENT_KINDS = {
    "hiến pháp": "hien_phap", "bộ luật": "luat", "luật": "luat", "pháp lệnh": "phap_lenh", "nghị định": "nghi_dinh", "nghị quyết": "nghi_quyet", "quyết định": "quyet_dinh",
    "thông tư liên tịch": "thong_tu", "thông tư": "thong_tu", "chỉ thị": "chi_thi",
}
# Cross-reference predicates and their names.
CROSSREF_TYPES = {
    "THAM_CHIẾU": "references", "SỬA_ĐỔI": "amends", "THAY_THẾ": "supersedes", "BÃI_BỎ": "repeals", "HƯỚNG_DẪN": "implements", "ĐỊNH_NGHĨA_TẠI": "defined_in",
    "ĐỀ_CẬP_TẠI": "mentioned_in", "QUY_ĐỊNH_VỀ": "regulates",
}

# Which types of subject and object a predicate may have.
PREDICATE_RULES = {
    "CÓ_QUYỀN": (("ORGANIZATION", "PERSON_ROLE"), ("ACTION", "LEGAL_TERM")),
    "CÓ_NGHĨA_VỤ": (("ORGANIZATION", "PERSON_ROLE"), ("ACTION", "LEGAL_TERM")),
    "ĐỊNH_NGHĨA_LÀ": (("ORGANIZATION", "LEGAL_TERM", "PERSON_ROLE"), ("LEGAL_TERM", "ORGANIZATION")),
    "VI_PHẠM": (("ACTION", "ORGANIZATION", "PERSON_ROLE"), ("LEGAL_TERM", "ACTION")),
    "CHỊU_TRÁCH_NHIỆM": (("ORGANIZATION", "PERSON_ROLE"), ("ACTION", "LEGAL_TERM")),
    "NGHIÊM_CẤM": (("ORGANIZATION", "PERSON_ROLE"), ("ACTION",)),
    "YÊU_CẦU": (("ORGANIZATION", "PERSON_ROLE", "LEGAL_TERM", "LEGAL_REFERENCE"), ("LEGAL_TERM", "ACTION", "ORGANIZATION", "MONETARY", "DURATION")),
    "BAO_GỒM": (("ORGANIZATION", "LEGAL_TERM", "LEGAL_REFERENCE"), ("ORGANIZATION", "LEGAL_TERM", "ACTION", "LEGAL_REFERENCE")),
    "THAM_CHIẾU": (("LEGAL_TERM", "LEGAL_REFERENCE"), ("LEGAL_TERM", "LEGAL_REFERENCE")),
    "QUY_ĐỊNH_VỀ": (("LEGAL_REFERENCE", "LEGAL_TERM"), ("ORGANIZATION", "LEGAL_TERM", "ACTION", "PERSON_ROLE")),
    "BAN_HÀNH": (("ORGANIZATION",), ("LEGAL_REFERENCE", "LEGAL_TERM")),
    "ÁP_DỤNG_TẠI": (("LEGAL_TERM", "LEGAL_REFERENCE", "ORGANIZATION"), ("LOCATION",)),
    "THỰC_HIỆN": (("ORGANIZATION", "PERSON_ROLE"), ("ACTION", "LEGAL_TERM")),
    "PHỐI_HỢP": (("ORGANIZATION", "PERSON_ROLE"), ("ORGANIZATION", "PERSON_ROLE")),
}

# Weights and limits of retrieval.
DUAL_WEIGHTS = {"keyphrase": 0.05, "semantic": 0.20, "ppr": 0.25, "concept": 0.20, "theme": 0.15, "hierarchy": 0.15}
RRF_K = 60
RRF_WEIGHTS = {"tree": 0.8, "dual": 1.0, "kg": 1.2}
CUTOFFS = (1, 3, 5, 10, 20, 30, 40, 50)
STRONG_RELATIONS = ("REFERENCES", "REQUIRES", "DEPENDS_ON", "IMPLEMENTS")
EXPANSION_RELATIONS = ("DEFINED_AS", "CONDITION_FOR", "RELATED_TO", "INCLUDES")
VIETNAMESE_VOWELS = "AĂÂEÊIOÔƠUƯYÀÁẢÃẠẰẮẲẴẶẦẤẨẪẬÈÉẺẼẸỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌỒỐỔỖỘỜỚỞỠỢÙÚỦŨỤỪỨỬỮỰỲÝỶỸỴ"


def accent_map() -> tuple[str, str]:
    """The letters of Vietnamese with marks and the letters without, both cases, made by rule."""
    marked = []
    for base in "aăâeêioôơuưy":
        for tone in ("", "̀", "́", "̃", "̉", "̣"):
            c = unicodedata.normalize("NFC", base + tone)
            if ord(c) > 127:
                marked.append(c)
    plain = [unicodedata.normalize("NFD", c)[0] for c in marked]
    marked.append("đ")
    plain.append("d")
    return "".join(marked) + "".join(c.upper() for c in marked), "".join(plain) + "".join(c.upper() for c in plain)


def _all_forms(types: dict[str, str]) -> dict[str, str]:
    a, b = accent_map()
    fold = str.maketrans(a, b)
    return types | {k.translate(fold): v for k, v in types.items()} | {v: v for v in types.values()}


def relation_type_map() -> dict[str, str]:
    """RELATION_TYPES with the forms without accents and the types themselves."""
    return _all_forms(RELATION_TYPES)


def entity_type_map() -> dict[str, str]:
    """ENTITY_TYPES likewise."""
    return _all_forms(ENTITY_TYPES)
