"""Vocabularies and patterns of a text-signal domain, as data."""

from __future__ import annotations

from dataclasses import dataclass


def any_word(*words: str) -> str:
    """Whole words, whatever their case, with Unicode word bounds."""
    return rf"(?iU)\b(?:{'|'.join(words)})\b"


def any_of(*parts: str) -> str:
    return f"(?iU)(?:{'|'.join(parts)})"


@dataclass(frozen=True)
class Lexicon:
    up: str
    down: str
    stable: str
    flat: str
    recover: str
    slump: str
    noise: str
    place: str
    price: str
    change: str
    high_terms: tuple[str, ...] = ()
    medium_terms: tuple[str, ...] = ()
    low_terms: tuple[str, ...] = ()
    paragraph_noise: str = "(?!)"
    paragraph_price: str = "(?!)"
    #: Prices in the printed pattern of titles and snippets: leading and trailing digits are two groups.
    split_price: str = "(?!)"
    price_low: float = 30_000
    price_high: float = 250_000
    change_cap: float = 20_000


#: Flags of the published patterns that ignore case: with Unicode letters, digits and word bounds.
ANY_CASE = "(?iU)"

# Fixed values of the coffee-price domain, as published; each pattern stands with the flags that it is used with.
COFFEE_TITLE = Lexicon(
    up=ANY_CASE + r"\btăng\b|tăng vọt|cao hơn",
    down=ANY_CASE + r"\bgiảm\b|sụt|lao dốc",
    stable=ANY_CASE + r"ổn định|đi ngang|giữ nguyên",
    flat=ANY_CASE + r"đi ngang",
    recover=ANY_CASE + r"phục hồi",
    slump=ANY_CASE + r"sụt|lao dốc",
    noise=ANY_CASE + r"mua ngay|đặt hàng online|hotline.*:\s*\d",
    # Place names have the case that they are written with.
    place="(?U)" + r"[Đđ]ắk\s*[Ll]ắk" + "|" + r"[Tt]ây\s*[Nn]guyên",
    price=ANY_CASE + r"\b(\d{2,3}[.,]\d{3})\s*(?:đồng|VNĐ|VND|đ/kg|đồng/kg)",
    change=ANY_CASE + r"(?:tăng|giảm)\s+(\d{1,3}[.,]\d{3})\s*(?:đồng|VNĐ|đ)?",
    high_terms=("giá cà phê", "cà phê robusta", "cà phê arabica", "đồng/kg"),
    medium_terms=("cà phê", "robusta", "arabica"),
    low_terms=("tăng", "giảm", "ổn định", "đi ngang", "Đắk Lắk", "Lâm Đồng", "Tây Nguyên", "Gia Lai", "Đắk Nông", "thị trường", "xuất khẩu"),
    paragraph_price=ANY_CASE + r"\d{2,3}[.,]\d{3}\s*(?:đồng|VNĐ|VND|đ/kg|đồng/kg)",
    split_price=ANY_CASE + r"\b(\d{2,3})[.,](\d{3})\s*(?:đồng|VNĐ|VND|đ/kg|đồng/kg)",
    paragraph_noise=ANY_CASE + (
        r"hotline|thời tiết.{0,5}\d+°|VNI:|HNX:|UPCOM|VN30:|đóng cửa|xem thêm|bình luận|đăng nhập|đăng ký|quảng cáo|google play|app store|trang chủ|liên hệ chúng tôi|"
        r"bản quyền|copyright|cookie|chính sách bảo mật|youtube|facebook|twitter|instagram|tiktok|tin cùng chuyên mục|tin liên quan|bài viết khác|đọc thêm|tags?:|"
        r"theo dõi chúng tôi|tải ứng dụng|VOV\d|nhảy đến nội dung"),
)
COFFEE_BODY = Lexicon(
    up=ANY_CASE + r"\btăng\b",
    down=ANY_CASE + r"\bgiảm\b",
    stable=ANY_CASE + r"ổn định",
    flat=ANY_CASE + r"đi ngang",
    recover=ANY_CASE + r"phục hồi",
    slump=ANY_CASE + r"sụt|lao dốc",
    noise=COFFEE_TITLE.noise,
    place=COFFEE_TITLE.place,
    price=ANY_CASE + r"\b(\d{2,3}[.,]\d{3})\s*(?:đồng|VNĐ|VND|vnđ)",
    change=COFFEE_TITLE.change,
)
RELEVANT = ("coffee", "caffeine", "espresso", "latte", "cappuccino", "cà phê", "robusta", "arabica")

#: The same roles played by frequent words of plain prose.
PROSE = Lexicon(
    up=any_word("the", "and"), down=any_word("der", "que"), stable=any_word("that", "for"), flat=any_word("in"), recover=any_word("is"),
    slump=any_word("les"), noise=any_of("all rights reserved"), place=any_of("://"), price=COFFEE_BODY.price, change=COFFEE_BODY.change,
    high_terms=("tion", "ción"), medium_terms=("the", "que"), low_terms=("and", "der", "les", "que"), paragraph_noise=any_of("all rights reserved", "copyright"),
    paragraph_price=COFFEE_TITLE.paragraph_price, split_price=COFFEE_TITLE.split_price,
)
