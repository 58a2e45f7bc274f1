"""Regular expressions in Java's dialect, and the words they are made of.

Classes and case folding are those of Unicode throughout: `(?iU)` or `(?U)` in front.
All apply to text after `norm_ja`.
"""

from __future__ import annotations

import re

_SEPARATOR = r"[\s：:・/＝=約]*(?:\([^)]{1,6}\))?[\s：:・/＝=約]*"
_NUMBER = r"(\d{1,3}(?:\.\d{1,2})?)"


def label_value(*labels: str) -> str:
    """A label, separators, a number of centimetres (group 1) and an optional unit."""
    return rf"(?iU)(?:{'|'.join(re.escape(x) for x in labels)}){_SEPARATOR}{_NUMBER}\s*(?:cm|CM|㎝|センチ)?"


#: The labels of each measure.
LABELS = {
    "shoulder": ("肩幅", "肩 幅", "ショルダー"),
    "chest": ("身幅", "胸幅"),
    "girth": ("バスト", "胸囲"),
    "length": ("着丈", "ジャケット丈", "身丈"),
    "sleeve": ("袖丈", "袖 丈", "スリーブ"),
    "waist_flat": ("ウエスト平置き", "ウェスト平置き", "腰幅", "ウエスト（平置き）", "ウェスト（平置き）", "W平置き", "ウエスト 平置き", "ウェスト 平置き"),
    "waist_girth": ("ウエスト周り", "ウェスト周り", "ウエストぐるり", "ウェストぐるり", "ウエスト（ぐるり）", "W周囲", "ウエスト実寸", "ウェスト実寸"),
    "waist": ("ウエスト", "ウェスト", "W"),
    "rise": ("股上", "ライズ"),
    "inseam": ("股下", "インシーム"),
    "hem_width": ("裾幅", "裾 幅", "裾巾"),
    "thigh": ("ワタリ", "渡り", "渡り幅", "もも幅", "腿幅"),
    "total_length": ("総丈", "全丈", "パンツ丈"),
}
MEASURES = {name: label_value(*labels) for name, labels in LABELS.items()}

HEM_DOUBLE = r"(?iU)裾\s*(?:ダブル|W|double)"
HEM_SINGLE = r"(?iU)裾\s*(?:シングル|S|single)"

#: Size tokens in the order in which a text is searched for them, and what each is called.
SIZE_ORDER = ("5XL", "4XL", "3XL", "2XL", "XXL", "LL", "XL", "XS", "S", "M", "L")
SIZE_NAMES = {
    "5xl": "5XL", "5xo": "5XL", "5l": "5XL",
    "4xl": "4XL", "4xo": "4XL", "4l": "4XL",
    "3xl": "3XL", "3xo": "3XL", "3l": "3XL",
    "xxl": "2XL", "2xl": "2XL", "2xo": "2XL", "2l": "2XL", "ll": "2XL",
    "xl": "XL", "l": "L", "m": "M", "s": "S", "xs": "XS",
}
SIZE_ROW = r"(?U)[【\[]\s*([\dA-Za-z]+)\s*(?:サイズ|SIZE)?\s*[】\]]([^\n【\[]+)"


def size_token(size: str) -> str:
    return rf"(?iU)(?<![A-Z0-9]){size}(?![A-Z0-9])"


#: Fixed patterns of prices.
CURRENT = r"(?iU)現在\s*(?:価格|入札額)?[：:\s]*([0-9,，]+)\s*円"
BUY_NOW = r"(?iU)即決\s*(?:価格)?[：:\s]*([0-9,，]+)\s*円"
WINNING = r"(?iU)落札(?:価格|金額)?[：:\s]*([0-9,，]+)\s*円"
SHIPPING = r"(?iU)送料\s*([0-9,，]+)\s*円"
SHIPPING_FREE = r"(?iU)送料\s*(?:無料|込み|込)"
FIXED = r"(?iU)(?:販売価格|定価|金額)[：:\s]*([0-9,，]+)\s*円"
ANY_PRICE = r"(?U)([0-9,，]{3,})\s*円"

#: Fixed patterns of the state of a sale, in the order in which they give the evidence.
SOLD = (r"(?iU)落札済み?", r"(?iU)sold\s*out", r"(?iU)売り?切れ", r"(?iU)購入済み?")
ENDED = (r"(?iU)終了(?!します|予定|日時)", r"(?iU)オークション終了", r"(?iU)期限切れ", r"(?iU)出品終了")
ACTIVE = (r"(?iU)出品中", r"(?iU)販売中", r"(?iU)入札受付中", r"(?iU)出品中・送料込み", r"(?iU)残り\s*\d+\s*(?:日|時間|分)")

#: Fixed patterns of fibres, in the order in which they are listed.
FIBERS = {
    "wool": r"ウール|ウル|毛(?=\d|100)|wool|w(?=\s*\d+\s*%)",
    "mohair": r"モヘア|モヘヤ|mohair",
    "polyester": r"ポリエステル|polyester|poly(?=\s*\d)",
    "polyurethane": r"ポリウレタン|polyurethane|pu(?=\s*\d)",
    "cotton": r"コットン|綿|cotton",
    "silk": r"シルク|絹|silk",
    "linen": r"リネン|麻|linen",
    "cashmere": r"カシミア|カシミヤ|cashmere",
    "nylon": r"ナイロン|nylon",
    "rayon": r"レーヨン|人絹|rayon",
    "acetate": r"アセテート|acetate",
    "acrylic": r"アクリル|acrylic",
}
ANY_FIBER = "(?iU)" + "|".join(FIBERS.values())
OUTER = r"(?iU)表地|表生地|アウター|外生地"
LINING = r"(?iU)裏地|裏生地|ライニング"
SECTION = r"(?iU)(?:素\s*材|材\s*質|生\s*地)[：:\s]"


def fiber_share(fiber: str) -> str:
    """A fibre's name; group 1 is the percentage behind it, if one follows within a few separators."""
    return rf"(?iU)(?:{FIBERS[fiber]})(?=(?:[\s：:/＝=]{{0,11}}(\d{{1,3}}))?)"


#: Other names of fibres.
FIBER_NAMES = {
    "wool": ("ウール", "wool", "毛", "ウル"),
    "polyester": ("ポリエステル", "polyester", "ポリ"),
    "polyurethane": ("ポリウレタン", "polyurethane", "pu"),
    "cotton": ("コットン", "cotton", "綿"),
    "mohair": ("モヘア", "mohair", "モヘヤ"),
    "silk": ("シルク", "silk", "絹"),
    "linen": ("リネン", "linen", "麻"),
    "cashmere": ("カシミア", "cashmere", "カシミヤ"),
    "nylon": ("ナイロン", "nylon"),
    "rayon": ("レーヨン", "rayon", "人絹"),
    "acetate": ("アセテート", "acetate"),
    "acrylic": ("アクリル", "acrylic"),
}

#: Fixed patterns of style.
DOUBLE = r"(?iU)(?<!裾)ダブル(?:ブレスト|スーツ|ジャケット)?|double\s*breasted|wブレスト"
SINGLE = r"(?iU)シングル(?:ブレスト|スーツ|ジャケット)?|single\s*breasted|sブレスト"
BUTTONS = r"(?U)(\d)\s*(?:ボタン|B\b|つボタン)"
BUTTONS_WORD = r"(?U)([一二三四五ひとつふたみっ]+)\s*(?:ボタン|つボタン)"
BUTTON_WORDS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "ひとつ": 1, "ふたつ": 2, "みっつ": 3}
BUTTON_COLORS = {
    "gold": r"(?iU)金ボタン|ゴールド(?:ボタン)?|gold\s*button",
    "silver": r"(?iU)銀ボタン|シルバー(?:ボタン)?|silver\s*button",
    "black": r"(?iU)黒ボタン|ブラック(?:ボタン)?|black\s*button",
}

#: Fixed patterns of condition, grades in the order of the checks.
GRADES = {
    "S": r"(?iU)s\s*ランク|未使用|新品同様|デッドストック",
    "A": r"(?iU)a\s*ランク|美品|良好|目立った.*なし",
    "B": r"(?iU)b\s*ランク|普通|やや使用感|多少.*あり",
    "C": r"(?iU)c\s*ランク|使用感.*あり|傷.*あり",
    "D": r"(?iU)d\s*ランク|ジャンク|難あり|訳あり",
}
STAIN = r"(?iU)汚れ\s*(?:が|は|あり|有り|あります|ございます)|シミ\s*あり|ステイン"
NO_STAIN = r"(?iU)汚れ\s*(?:なし|無し|ございません|はありません|ありません)|シミ\s*なし|目立った汚れ\s*(?:なし|無し|はありません|ありません)"
SEVERE_STAIN = r"(?iU)ひどい汚れ|大きな汚れ|酷い汚れ|目立つ汚れ\s*(?:あり|有り)"
HOLE = r"(?iU)穴\s*(?:あり|有り|あります|開き)|破れ\s*あり|ほつれ\s*あり"
NO_HOLE = r"(?iU)穴\s*(?:なし|無し|ありません|はありません)|破れ\s*なし"

#: A text that matches holds one of these words, in lower case; looked for first, as that is far cheaper.
WORDS = {
    "style": ("ダブル", "double", "wブレスト", "シングル", "single", "sブレスト"),
    "buttons": ("ボタン", "b"),
    "color": ("ボタン", "ゴールド", "gold", "シルバー", "silver", "ブラック", "black"),
    "grade": (
        "ランク", "未使用", "新品同様", "デッドストック", "美品", "良好", "目立った", "普通", "使用感", "多少", "傷", "ジャンク", "難あり", "訳あり",
    ),
    "stain": ("汚れ", "シミ", "ステイン"),
    "hole": ("穴", "破れ", "ほつれ"),
}
#: The same for each fibre: the alternatives of its pattern without what must follow them.
FIBER_WORDS = {fiber: tuple(re.sub(r"\(.*\)", "", x) for x in re.split(r"\|(?![^(]*\))", pattern)) for fiber, pattern in FIBERS.items()}
