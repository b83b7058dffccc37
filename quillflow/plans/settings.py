"""Configuration of the queries: laws, templates, lists and rules.  Fixed values."""

LAWS = [
    ("Bộ luật Dân sự", ["BLDS", "bộ luật dân sự 2015", "bộ luật dân sự", "luật dân sự", "bộ luật ds"], ["Bộ luật dân sự 2015", "Văn bản hợp nhất bộ luật dân sự"]),
    ("Luật Doanh nghiệp", ["LDN", "luật doanh nghiệp 2020", "luật doanh nghiệp", "luật dn"], ["Luật doanh nghiệp 2020", "Văn bản hợp nhất luật doanh nghiệp"]),
    ("Luật Trọng tài thương mại", ["LTTTM", "luật trọng tài thương mại 2010", "luật trọng tài thương mại", "luật tttm"], ["Luật trọng tài thương mại 2010", "Văn bản hợp nhất luật trọng tài thương mại"]),
]
TEMPLATES = [
    ("search_latest_version", "Toàn văn {law_name} mới nhất site:thuvienphapluat.vn OR site:congbao.chinhphu.vn", 1),
    ("search_amendments", "Văn bản hợp nhất {law_name} site:thuvienphapluat.vn", 1),
]
SOURCES = ["thuvienphapluat.vn", "congbao.chinhphu.vn"]
ALLOWED = {"thuvienphapluat.vn": ["/van-ban/"], "congbao.chinhphu.vn": ["/van-ban/"]}
DENIED = [
    "/hoi-dap-phap-luat/", "/cong-dong-dan-luat/", "/ma-so-thue/", "/thu-tuc-phap-ly/", "/tu-van-phap-luat/", "/tin-tuc-phap-luat/", "/phap-luat-vo-tao/", "/phap-luat/",
    "/bai-viet/", "/tin-tuc/", "/tags.html",
]
REFRESH_DAYS = 7
RULES = {
    "Bộ luật Dân sự": [
        {"type": "VBHN", "law_id_pattern": "VBHN", "title_pattern": "[Bb]ộ luật [Dd]ân sự", "sort_by": "effective_date", "sort_order": "desc"},
        {"type": "ORIGINAL", "law_id_pattern": r"QH\d{2}", "title_pattern": r"[Bb]ộ luật [Dd]ân sự \d{4}", "exclude_pattern": "sửa đổi", "sort_by": "effective_date", "sort_order": "desc"},
    ],
    "Luật Doanh nghiệp": [
        {"type": "VBHN", "law_id_pattern": "VBHN-VPQH", "title_pattern": "[Ll]uật [Dd]oanh nghiệp", "sort_by": "effective_date", "sort_order": "desc"},
        {"type": "AMENDMENT", "law_id_pattern": r"QH\d{2}", "title_pattern": "([Ss]ửa đổi.*[Ll]uật [Dd]oanh nghiệp|[Ll]uật [Dd]oanh nghiệp.*sửa đổi)", "sort_by": "effective_date", "sort_order": "desc"},
        {"type": "ORIGINAL", "law_id_pattern": r"QH\d{2}", "title_pattern": r"[Ll]uật [Dd]oanh nghiệp \d{4}", "exclude_pattern": "sửa đổi", "sort_by": "effective_date", "sort_order": "desc"},
    ],
    "Luật Trọng tài thương mại": [
        {"type": "VBHN", "law_id_pattern": "VBHN", "title_pattern": "[Ll]uật [Tt]rọng tài thương mại", "sort_by": "effective_date", "sort_order": "desc"},
        {"type": "ORIGINAL", "law_id_pattern": r"QH\d{2}", "title_pattern": r"[Ll]uật [Tt]rọng tài thương mại \d{4}", "exclude_pattern": "sửa đổi", "sort_by": "effective_date", "sort_order": "desc"},
    ],
}
MIN_CHARS = 5000
REQUIRED_KEYWORDS = ["Điều 1", "Khoản 1", "Chương I"]
BLACKLIST = ["Quảng cáo", "Liên hệ", "Đăng nhập", "Đăng ký", "Menu"]
