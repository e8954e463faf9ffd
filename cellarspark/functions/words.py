"""Word lists, stems and letter maps that the results depend on."""

# ---- fixed values ----
#: letters that look alike, Latin and Cyrillic side by side
LOOK_LATIN = "ABCEHKMOPTXY"
LOOK_CYRILLIC = "АВСЕНКМОРТХУ"
#: Latin letters that no Cyrillic letter looks like
DISTINCT_LATIN = "DFGIJLNQRSUVWZ"

GRAPE_STOP = "СОРТА СОРТ ВИНОГРАДА ВИНОГРАД БЕЛЫЙ БЕЛОЕ ЧЕРНЫЙ ЧЕРНОЕ КРАСНЫЙ КРАСНОЕ РОЗОВЫЙ РОЗОВОЕ СУХОЕ СУХОЙ СЛАДКОЕ СЛАДКИЙ".split()
NAME_STOP = GRAPE_STOP + (
    "ВИНО ВИНА ВИНОМ WINE VIN ПОЛУСУХОЕ ПОЛУСЛАДКОЕ ПОЛУСУХОЙ БРЮТ BRUT EXTRA DRY ИГРИСТОЕ ТИХОЕ ВЫДЕРЖКА ВЫДЕРЖАННОЕ РЕЗЕРВ RESERVE "
    "КРЫМ РОССИЯ RUSSIA CRIMEA ДОЛИНА ГОД УРОЖАЙ VINTAGE ОБЪЕМ АЛКОГОЛЬ ЗГУ ЗНМП THE AND ДЛЯ ОРАНЖЕВОЕ ВИНОДЕЛЬНЯ ВИНОДЕЛЬНИ ВИНОДЕЛЕН "
    "BELOE BELOYE BELAYA SUKHOE SUHOE SUKH KRASNOE ROZOVOE SLADKOE POLUSUKHOE POLUSUHOE IGRISTOE"
).split()
LINE_FILLERS = "КЮВЕ CUVEE CUVE KYUVE ULTRA GRANDE BRUT БРЮТ ROSE РОЗЕ EXTRA ЭКСТРА CHATEAU SHATO ШАТО".split()

COLOUR_WORDS = {
    "БЕЛОЕ": "white", "БЕЛЫЙ": "white", "БЕЛОГО": "white",
    "КРАСНОЕ": "red", "КРАСНЫЙ": "red", "КРАСНОГО": "red",
    "РОЗОВОЕ": "rose", "РОЗОВЫЙ": "rose", "РОЗОВОГО": "rose",
    "ОРАНЖЕВОЕ": "orange", "ОРАНЖЕВЫЙ": "orange",
}
#: tried in this order; a stem that is found is taken out before the next is tried
SWEET_STEMS = (
    ("ПОЛУСЛАД", "semi_sweet"), ("POLUSLAD", "semi_sweet"), ("ПОЛУСУХ", "semi_dry"), ("POLUSUH", "semi_dry"), ("POLUSUKH", "semi_dry"),
    ("БРЮТ", "brut"), ("BRUT", "brut"), ("СЛАДК", "sweet"), ("SLADK", "sweet"),
    ("СУХОЕ", "dry"), ("СУХОЙ", "dry"), ("СУХОГО", "dry"), ("SUHOE", "dry"), ("SUHOY", "dry"), ("SUKH", "dry"),
)
TASTE_STEMS = "ЯГОД ДУБ ЦИТРУС ВАНИЛ ШОКОЛАД ВИШН СЛИВ ЯБЛОК ЦВЕТОЧ МИНЕРАЛ МЕДОВ ПЕРСИК СМОРОДИН МАЛИН КЛУБНИК ТАНИН КАРАМЕЛ ЛИМОН АПЕЛЬСИН ГРЕЙПФРУТ АБРИКОС ЧЕРЕШН".split()
FOOD_STEMS = (("РЫБ", "fish"), ("МЯС", "meat"), ("СЫР", "cheese"), ("ДЕСЕРТ", "dessert"))
TASTE_WORDS = "ягоды дуб цитрус ваниль шоколад вишня слива яблоко цветы минерал мёд персик смородина малина клубника танин карамель лимон апельсин грейпфрут абрикос черешня".split()
SWEET_WORDS = {
    "СУХОЕ": "dry", "СУХОЙ": "dry", "СУХОГО": "dry",
    "СЛАДКОЕ": "sweet", "СЛАДКИЙ": "sweet", "СЛАДКОГО": "sweet",
    "ПОЛУСУХОЕ": "semi_dry", "ПОЛУСУХОЙ": "semi_dry",
    "ПОЛУСЛАДКОЕ": "semi_sweet", "ПОЛУСЛАДКИЙ": "semi_sweet",
    "БРЮТ": "brut", "BRUT": "brut",
}
#: readings of the word for the driest sparkling wine
BRUT_FORMS = ("PIOT", "BRUT", "SPIOT", "BPIOT")
COLOUR_SHOWN = {"white": "белое", "red": "красное", "rose": "розовое", "orange": "оранжевое"}
SWEET_SHOWN = {"dry": "сухое", "sweet": "сладкое", "semi_dry": "полусухое", "semi_sweet": "полусладкое", "brut": "брют"}
COLOUR_ASKED = {"БЕЛОЕ": "белое", "БЕЛЫЙ": "белое", "КРАСНОЕ": "красное", "КРАСНЫЙ": "красное", "РОЗОВОЕ": "розовое", "РОЗОВЫЙ": "розовое", "ОРАНЖЕВОЕ": "оранж", "ОРАНЖЕВЫЙ": "оранж", "ОРАНЖ": "оранж", "ORANGE": "оранж"}
SWEET_ASKED = {"БРЮТ": "брют", "BRUT": "брют", "СУХОЕ": "сухое", "СУХОЙ": "сухое", "СЛАДКОЕ": "сладкое", "СЛАДКИЙ": "сладкое", "ПОЛУСУХОЕ": "полусухое", "ПОЛУСУХОЙ": "полусухое", "ПОЛУСЛАДКОЕ": "полусладкое", "ПОЛУСЛАДКИЙ": "полусладкое"}
STYLE_WORDS = "оранж белое красное розовое брют сухое сладкое полусухое полусладкое кюве ultra".split()
GRAPE_PAIRS = {("ПИНО", "НУАР"): "Пино нуар", ("ПИНО", "ГРИ"): "Пино гри", ("ПИНО", "БЛАН"): "Пино блан", ("СОВИНЬОН", "БЛАН"): "Совиньон блан", ("КАБЕРНЕ", "СОВИНЬОН"): "Каберне совиньон", ("КАБЕРНЕ", "ФРАН"): "Каберне фран"}
#: other spellings of a grape's word
LATIN_GRAPES = {
    "ALIGOTE": "АЛИГОТЕ", "CHARDONNAY": "ШАРДОНЕ", "CABERNET": "КАБЕРНЕ", "SAUVIGNON": "СОВИНЬОН", "MERLOT": "МЕРЛО", "RIESLING": "РИСЛИНГ",
    "PINOT": "ПИНО", "PINO": "ПИНО", "INO": "ПИНО", "NOIR": "НУАР", "COBUNSON": "СОВИНЬОН", "COBVNSON": "СОВИНЬОН", "BLANC": "БЛАН",
    "SYRAH": "СИРА", "SHIRAZ": "ШИРАЗ", "MUSCAT": "МУСКАТ", "CITRON": "ЦИТРОННЫЙ", "TSITRON": "ЦИТРОННЫЙ", "CITRONNY": "ЦИТРОННЫЙ", "CITRONNYI": "ЦИТРОННЫЙ",
}
CLIPPED_GRAPES = {
    "ЦИТРОН": "ЦИТРОННЫЙ", "СОИНЬОН": "СОВИНЬОН", "СОИНЬОНЛАН": "СОВИНЬОН", "СОИНОН": "СОВИНЬОН", "СИР": "СИРА",
    "ПНО": "ПИНО", "УАР": "НУАР", "ЬАР": "НУАР", "ПОАР": "НУАР", "СВШНЬОН": "СОВИНЬОН",
}
LATIN_WINERIES = {"ARATTI": "АРАТТИ"}
#: readings that mean НУАР only beside a word for ПИНО
NOIR_GATED = ("HYAP", "HVAP", "ING")
PINOT_MARKS = ("ПИНО", "PINOT", "PINO", "INO", "ПНО")
NOIR_STEMS = ("НУАР", "NOIR", "УАР", "ЬАР", "ПОАР", "HYAP", "HVAP", "ING")
#: grapes of dozens of labels
COMMON_GRAPES = ("ПИНО", "СОВИНЬОН", "КАБЕРНЕ", "ШАРДОНЕ", "МЕРЛО", "РИСЛИНГ")
ASK_STOP = (
    "ВИНО ВИНА ВИНУ ВИНОМ ВИНЕ ВИННЫЙ ВИННОЕ ХОЧУ ХОТЕЛ ХОТЕЛА НУЖЕН НУЖНА НУЖНО КАКОЕ КАКОЙ КАКАЯ КАКИЕ ПОЖАЛУЙСТА ОЧЕНЬ МЕНЯ МНЕ "
    "БУТЫЛКА БУТЫЛКУ БУТЫЛОК БЕЛОЕ БЕЛЫЙ БЕЛОГО БЕЛУЮ КРАСНОЕ КРАСНЫЙ КРАСНОГО РОЗОВОЕ РОЗОВЫЙ РОЗОВОГО ОРАНЖЕВОЕ ОРАНЖЕВЫЙ "
    "СУХОЕ СУХОЙ СУХОГО СЛАДКОЕ СЛАДКИЙ СЛАДКОГО ПОЛУСУХОЕ ПОЛУСУХОЙ ПОЛУСЛАДКОЕ ПОЛУСЛАДКИЙ ВКУС ВКУСА ВКУСЕ ВКУСОМ СТИЛЬ СТИЛЯ "
    "ЕДА ЕДУ ЕДЕ ЕДЫ ХОРОШО ХОРОШЕЕ ХОРОШИЙ ХОРОШАЯ ПОДОЙДЕТ ПОДОБРАТЬ ПОДБЕРИ ПОДБЕРИТЕ"
).split()
#: what a shared attribute is called in an answer
REASONS = {"grape": "тот же сорт", "colour": "тот же цвет", "sweet": "похожая сладость", "brand": "общий бренд", "taste": "похожий вкус", "region": "тот же регион", "visual": "визуально близкая этикетка"}
# ---- end of fixed values ----
