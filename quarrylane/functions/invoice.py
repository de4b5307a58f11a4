"""Invoices with transport, bank and cargo sections, read from plain text: a struct of about 30 fields, null where not found."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields as fd
from .text import let, one_case

# White space of all scripts; an edge between a Latin letter, digit or underscore and anything else, Cyrillic letters included.
_S = r"[\s\p{Z}\x{FEFF}]"
_W = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_CITY = r"[А-ЯЁ][а-яё-]{1,24}(?: [А-ЯЁ][а-яё-]{1,24})?"
_DAY = r"([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{4})"
_NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
# What stands before each field, and how the field looks.
TOTAL_LABELS = (r"Итого\s+к\s+оплате", r"Всего\s+к\s+оплате", "Итого")
OGRN = rf"ОГРН(?:{_S}|[:№])*([0-9]{{15}}|[0-9]{{13}})(?![0-9])"
BIK = rf"БИК(?:{_S}|[:№])*([0-9]{{9}})(?![0-9])"
ACCOUNT = rf"(?:расч(?:[её]т|\.))?{_S}*(?:р/?с|сч[её]т)[^0-9\n]{{0,30}}([0-9]{{20}})(?![0-9])"
ANY_ACCOUNT = rf"{_EDGE}([0-9]{{20}}){_EDGE}"
CORRESPONDENT = rf"(?:к(?:орр)?\.?{_S}*с(?:ч[её]т)?|к/с)[^0-9\n]{{0,30}}([0-9]{{20}})(?![0-9])"
ORDER = rf"(?:заявк[аеи]|основани[еюя]|по{_S}+заявке|по{_S}+основанию)[^\n]{{0,80}}?{_EDGE}([A-Z]{{2,5}}-[0-9]{{4}}-[0-9]{{3,4}}){_EDGE}"
PLATE = rf"(?:гос\.?{_S}*номер|ТС(?:{_S}|:)|транспортное{_S}+средство|авто(?:мобиль)?(?:{_S}|:))[^\n]{{0,80}}?([АВЕКМНОРСТУХ][0-9]{{3}}[АВЕКМНОРСТУХ]{{2}}[0-9]{{2,3}})"
ROUTE = rf"(?:маршрут(?:{_S}+плеч[аи])?|направление|откуда[^\n]{{0,10}}куда)[^\n]*?(?:г\.?{_S}*)?({_CITY}){_S}*(?:→|->|–|—){_S}*(?:г\.?{_S}*)?({_CITY})"
PERMIT = rf"(?:спецразрешени[ею]|разрешени[еюя])[^\n]{{0,60}}?№?{_S}*([0-9]{{1,3}}-[0-9]{{4}}-[0-9]{{3,7}})"
DUE = rf"(?:оплатить{_S}+до|срок{_S}+оплаты|оплата{_S}+до)[^\n]{{0,30}}?{_DAY}"
VALID_TO = rf"(?:действ(?:ует|ительн{_W}*)|срок{_S}+действия|valid)[^\n]{{0,30}}?(?:до{_S}+)?{_DAY}"
MODEL = rf"{_EDGE}(MAN(?:{_S}+{_W}+(?:{_S}+[0-9]+\.[0-9]+)?)?|Volvo(?:{_S}+{_W}+)?|Scania(?:{_S}+{_W}+)?|DAF(?:{_S}+{_W}+)?|КАМАЗ(?:{_S}|-)?[0-9]+|Mercedes(?:(?:{_S}|-)Benz)?(?:{_S}+{_W}+)?|Iveco(?:{_S}+{_W}+)?)"
TRAILER = rf"{_EDGE}(Goldhofer(?:{_S}+[A-Za-z0-9_-]+)?|Faymonville(?:{_S}+[A-Za-z0-9_-]+)?|Nooteboom(?:{_S}+[A-Za-z0-9_-]+)?|Scheuerle(?:{_S}+[A-Za-z0-9_-]+)?|низкорамн{_W}*{_S}+трал(?:{_S}+{_W}+)?)"
AXLES = rf"([0-9]{{1,2}})(?:{_S}|-)*ос(?:ей|ный|ны|евой)"
ISSUER = rf"{_EDGE}(Росавтодор|Ространснадзор|ЦОДД|Минтранс{_S}+{_W}+|ГИБДД)"
TONNES, KILOS = rf"{_NUMBER}{_S}*т(?:онн)?{_EDGE}", rf"{_NUMBER}{_S}*кг{_EDGE}"
SIZE = rf"{_NUMBER}{_S}*[×xх]{_S}*{_NUMBER}{_S}*[×xх]{_S}*{_NUMBER}{_S}*м"
RAW_SIZE, OVERSIZED = rf"((?:габарит{_W}*|размер{_W}*)[^\n]{{0,80}})", r"негабарит|крупногабарит|тяжеловес"
CARGO = rf"(?:груз|перевозим{_W}*{_S}+груз){_S}*[:—-]{_S}*([^\n]{{5,120}})"
ESCORT = r"сопровожд|эскорт|escort"
ESCORT_TYPE = rf"(патрул[ьея]{_S}+ГИБДД|машин{_W}+{_S}+прикрытия|лоцман(?:{_S}|-)?водител{_W}*|эскорт{_S}+{_W}+)"
ESCORT_AREA = rf"(?:сопровожд{_W}*|эскорт)[^\n]{{0,80}}?(?:на|по){_S}+((?:[А-ЯЁа-яё-]+{_S}*){{1,4}}участк{_W}*|весь{_S}+маршрут)"
# Ways of payment and kinds of legs, the first that fits.
PAYMENTS = (
    (rf"{_EDGE}(нал(?:ичн|ични)|cash)", "cash"), (rf"{_EDGE}(банковск{_W}*{_S}+перевод|безналичн{_W}*|б/?н{_EDGE}|bank{_S}*transfer)", "bank_transfer"),
    (rf"{_EDGE}(предоплат{_W}*|аванс|prepay)", "prepayment"), (rf"{_EDGE}(постоплат{_W}*|оплата{_S}+после|postpay)", "postpayment"), (rf"{_EDGE}(карт(?:а|ой)|card)", "card"),
)
LEGS = (
    (rf"жд|железнодорожн{_W}*|ж\.д\.", "rail"), (rf"морск{_W}*|sea|vessel|контейнерн{_W}+{_S}+перевозк{_W}*", "sea"), (rf"авиа{_W}*|air{_S}*freight|самол[её]т{_W}*", "air"),
    (rf"таможен{_W}*|customs|растаможк{_W}*", "customs"), (rf"автотранспорт{_W}*|автоперевозк{_W}*|низкорамн{_W}+{_S}+трал|тягач|фур[ау]", "auto"),
)


# What a text in one case holds, one of them at least, if a pattern matches it; of a pattern, what stands there.
HOLDS = {
    OGRN: ("огрн",), BIK: ("бик",), ORDER: ("заявк", "основани"), PLATE: ("гос", "тс", "транспортное", "авто"), ROUTE: ("маршрут", "направление", "откуда"), PERMIT: ("разрешени",),
    DUE: ("оплатить", "срок", "оплата"), VALID_TO: ("действ", "срок", "valid"), MODEL: ("man", "volvo", "scania", "daf", "камаз", "mercedes", "iveco"), TRAILER: ("goldhofer", "faymonville", "nooteboom", "scheuerle", "низкорамн"),
    AXLES: ("осей", "осны", "осев"), ISSUER: ("росавтодор", "ространснадзор", "цодд", "минтранс", "гибдд"), RAW_SIZE: ("габарит", "размер"), OVERSIZED: ("негабарит", "крупногабарит", "тяжеловес"), CARGO: ("груз", "перевозим"),
    ESCORT: ("сопровожд", "эскорт", "escort"), ESCORT_TYPE: ("патрул", "машин", "лоцман", "эскорт"), ESCORT_AREA: ("сопровожд", "эскорт"),
    PAYMENTS[0][0]: ("налич", "cash"), PAYMENTS[1][0]: ("банковск", "безналичн", "бн", "б/н", "bank"), PAYMENTS[2][0]: ("предоплат", "аванс", "prepay"), PAYMENTS[3][0]: ("постоплат", "оплата", "postpay"), PAYMENTS[4][0]: ("карта", "картой", "card"),
    LEGS[0][0]: ("жд", "железнодорожн", "ж.д."), LEGS[1][0]: ("морск", "sea", "vessel", "контейнерн"), LEGS[2][0]: ("авиа", "air", "самол"), LEGS[3][0]: ("таможен", "customs", "растаможк"), LEGS[4][0]: ("автотранспорт", "автоперевозк", "низкорамн", "тягач", "фур"),
}
LOOKS = {ACCOUNT: "[0-9]{20}", ANY_ACCOUNT: "[0-9]{20}", CORRESPONDENT: "[0-9]{20}", TONNES: rf"[0-9]{_S}*+т", KILOS: rf"[0-9]{_S}*+кг", SIZE: rf"[0-9]{_S}*+[×xх]"}


class _Text:
    """A text, and the same in one case (``text.one_case``). A pattern is tried where the latter holds what it needs: trying
    one at each character, in either case, costs far more."""

    def __init__(self, text: Column, folded: Column):
        self.text, self.folded = text, folded

    def may(self, pattern: str) -> Column:
        if pattern in LOOKS:
            return self.folded.rlike(LOOKS[pattern])
        return self.holds(*HOLDS[pattern])

    def holds(self, *words: str) -> Column:
        return reduce(or_, [F.contains(self.folded, F.lit(word)) for word in words])

    def matches(self, pattern: str) -> Column:
        return self.may(pattern) & self.text.rlike(f"(?iu){pattern}")

    def hit(self, pattern: str, group: int = 1) -> Column:
        return F.when(self.may(pattern), F.regexp_extract(self.text, f"(?iu){pattern}", group))

    def found(self, pattern: str) -> Column:
        return let(F.trim(self.hit(pattern)), lambda x: F.when(x != "", x))

    def all(self, pattern: str) -> Column:
        return F.when(self.may(pattern), F.regexp_extract_all(self.text, F.lit(f"(?iu){pattern}"), F.lit(1)))

    def day(self, pattern: str) -> Column:
        """The date behind a label as yyyy-mm-dd."""
        hit = F.when(self.may(pattern), F.regexp_extract(self.text, f"(?iu)({pattern})", 1))
        return let(hit, lambda hit: F.when(hit != "", F.regexp_replace(F.concat_ws("-", F.regexp_extract(hit, _DAY, 3), F.lpad(F.regexp_extract(hit, _DAY, 2), 2, "0"), F.lpad(F.regexp_extract(hit, _DAY, 1), 2, "0")), " ", "")))

    def word(self, table: tuple[tuple[str, str], ...]) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, name in table:
            out = out.when(self.matches(pattern), name)
        return out


def _group(hit: Column, pattern: str, group: int) -> Column:
    """A group of a pattern without edges, read from what the whole pattern matched."""
    return let(F.trim(F.regexp_extract(hit, f"(?iu){pattern}", group)), lambda x: F.when(x != "", x))


def _some(**parts: Column) -> Column:
    """A struct of the parts, null if all are."""
    return let(F.struct(*[v.alias(k) for k, v in parts.items()]), lambda s: F.when(reduce(or_, [s[k].isNotNull() for k in parts]), s))


def _decimal(raw: Column) -> Column:
    return F.translate(raw, ",", ".").try_cast("double")


def _cargo(t: _Text) -> Column:
    weight = F.coalesce(let(_decimal(t.found(TONNES)), lambda x: F.floor(x * 1000 + 0.5).cast("double")), _decimal(t.found(KILOS)))

    def with_size(hit: Column) -> Column:
        size = let(F.array(*[_decimal(_group(hit, SIZE, i)) for i in (1, 2, 3)]), lambda a: F.when(a[0].isNotNull(), F.struct(a[0].alias("length_m"), a[1].alias("width_m"), a[2].alias("height_m"))))
        return _some(weight_kg=weight, dimensions=F.when(hit != "", size), dimensions_raw=F.when(hit == "", t.found(RAW_SIZE)), oversized=F.when(t.matches(OVERSIZED), True), description=t.found(CARGO))

    return let(F.coalesce(t.hit(SIZE, 0), F.lit("")), with_size)


def _escort(t: _Text) -> Column:
    return F.when(t.matches(ESCORT), F.struct(F.lit(True).alias("required"), t.found(ESCORT_TYPE).alias("type"), t.found(ESCORT_AREA).alias("area")))


def invoice(text: Column) -> Column:
    """number, date, total, vat, vat_rate, seller, buyer, order_ref, vehicle, route_from, route_to, permit_no, due_date,
    payment_method and transport (route, permit, cargo, escort) of an invoice's text. Parties take the first and the second
    taxpayer and registration number, the seller the bank's numbers."""

    def read(text: Column, folded: Column, pair: Column, ogrn: Column, route: Column) -> Column:
        t = _Text(text, folded)
        parts = F.struct(
            fd.find_doc_number(text, "счёт|счет").alias("number"), fd.find_date(text).alias("date"), fd.find_money(text, *TOTAL_LABELS).alias("total"), F.when(t.holds("ндс"), fd.find_vat(text)).alias("vat"), F.when(t.holds("ндс"), fd.find_vat_rate(text)).alias("vat_rate"),
            _some(inn=pair["seller"], ogrn=F.get(ogrn, F.lit(0)), bik=t.found(BIK), account=F.coalesce(t.found(ACCOUNT), t.found(ANY_ACCOUNT)), corr_account=t.found(CORRESPONDENT)).alias("seller"),
            _some(inn=pair["buyer"], ogrn=F.get(ogrn, F.lit(1))).alias("buyer"), t.found(ORDER).alias("order_ref"),
            _some(plate=F.upper(t.found(PLATE)), model=t.found(MODEL), trailer=t.found(TRAILER), axles=t.found(AXLES).cast("int")).alias("vehicle"),
            _group(route, ROUTE, 1).alias("route_from"), _group(route, ROUTE, 2).alias("route_to"), t.found(PERMIT).alias("permit_no"), t.day(DUE).alias("due_date"), t.word(PAYMENTS).alias("payment_method"),
            t.word(LEGS).alias("leg"), t.found(ISSUER).alias("issuer"), t.day(VALID_TO).alias("valid_to"), _cargo(t).alias("cargo"), _escort(t).alias("escort"),
        )

        def whole(x: Column) -> Column:
            kept = ("number", "date", "total", "vat", "vat_rate", "seller", "buyer", "order_ref", "vehicle", "route_from", "route_to", "permit_no", "due_date", "payment_method")
            route = F.when(F.coalesce(x["route_from"], x["route_to"], x["leg"]).isNotNull(), F.struct(x["route_from"].alias("from"), x["route_to"].alias("to"), x["leg"].alias("leg_kind")))
            issued = F.when(F.coalesce(x["permit_no"], x["issuer"], x["valid_to"]).isNotNull(), F.struct(x["permit_no"].alias("number"), x["issuer"].alias("issued_by"), x["valid_to"].alias("valid_to")))
            return F.struct(*[x[k].alias(k) for k in kept], F.struct(route.alias("route"), issued.alias("permit"), x["cargo"].alias("cargo"), x["escort"].alias("escort")).alias("transport"))

        return let(parts, whole)

    def opened(x: Column) -> Column:
        t = _Text(x["text"], x["folded"])
        several = F.struct(x["text"].alias("text"), x["folded"].alias("folded"), fd.tax_pair(x["text"]).alias("pair"), t.all(OGRN).alias("ogrn"), t.hit(ROUTE, 0).alias("route"))
        return let(several, lambda y: read(y["text"], y["folded"], y["pair"], y["ogrn"], y["route"]))

    return let(text, lambda t: let(F.struct(t.alias("text"), one_case(t).alias("folded")), opened))
