"""Words that sound alike, and letters that are mistaken for each other."""

# Fixed values, in their given order.
HOMOPHONES = {
    "accept": ("except",), "affect": ("effect",), "allowed": ("aloud",), "aloud": ("allowed",), "ant": ("aunt",), "ate": ("eight",), "aunt": ("ant",),
    "bare": ("bear",), "bear": ("bare",), "board": ("bored",), "bored": ("board",), "brake": ("break",), "break": ("brake",), "buy": ("by", "bye"),
    "by": ("buy", "bye"), "bye": ("by", "buy"), "cell": ("sell",), "cent": ("sent", "scent"), "coarse": ("course",), "complement": ("compliment",),
    "compliment": ("complement",), "course": ("coarse",), "dear": ("deer",), "deer": ("dear",), "die": ("dye",), "dye": ("die",),
    "effect": ("affect",), "eight": ("ate",), "except": ("accept",), "fair": ("fare",), "fare": ("fair",), "flour": ("flower",), "flower": ("flour",),
    "for": ("four", "fore"), "fore": ("for", "four"), "four": ("for", "fore"), "guessed": ("guest",), "guest": ("guessed",), "heard": ("herd",),
    "hear": ("here",), "herd": ("heard",), "here": ("hear",), "hole": ("whole",), "hour": ("our",), "it's": ("its",), "its": ("it's",),
    "knew": ("new",), "knight": ("night",), "know": ("no",), "knows": ("nose",), "lessen": ("lesson",), "lesson": ("lessen",), "mail": ("male",),
    "male": ("mail",), "meat": ("meet",), "medal": ("meddle", "metal"), "meet": ("meat",), "metal": ("medal",), "morning": ("mourning",),
    "mourning": ("morning",), "new": ("knew",), "night": ("knight",), "no": ("know",), "nose": ("knows",), "one": ("won",), "our": ("hour",),
    "pair": ("pear", "pare"), "passed": ("past",), "past": ("passed",), "patience": ("patients",), "patients": ("patience",), "peace": ("piece",),
    "pear": ("pair",), "piece": ("peace",), "plain": ("plane",), "plane": ("plain",), "poor": ("pour", "pore"), "pour": ("poor",),
    "principal": ("principle",), "principle": ("principal",), "rain": ("reign", "rein"), "reign": ("rain",), "right": ("write", "rite"),
    "rite": ("right",), "road": ("rode", "rowed"), "rode": ("road",), "role": ("roll",), "roll": ("role",), "sail": ("sale",), "sale": ("sail",),
    "scene": ("seen",), "scent": ("sent", "cent"), "sea": ("see",), "see": ("sea",), "seen": ("scene",), "sell": ("cell",), "sent": ("cent", "scent"),
    "sew": ("so", "sow"), "so": ("sew", "sow"), "some": ("sum",), "son": ("sun",), "steal": ("steel",), "steel": ("steal",), "sum": ("some",),
    "sun": ("son",), "tail": ("tale",), "tale": ("tail",), "than": ("then",), "their": ("there", "they're"), "then": ("than",),
    "there": ("their", "they're"), "they're": ("their", "there"), "threw": ("through",), "through": ("threw",), "to": ("too", "two"),
    "too": ("to", "two"), "two": ("to", "too"), "waist": ("waste",), "wait": ("weight",), "waste": ("waist",), "weak": ("week",),
    "wear": ("where", "ware"), "weather": ("whether",), "week": ("weak",), "weight": ("wait",), "we're": ("were",), "were": ("we're", "where"),
    "where": ("wear", "were"), "whether": ("weather",), "which": ("witch",), "whole": ("hole",), "witch": ("which",), "won": ("one",),
    "wood": ("would",), "would": ("wood",), "write": ("right",), "your": ("you're",), "you're": ("your",),
}

# Fixed values, in their given order.
CONFUSIONS = (
    ("ck", "k"), ("ph", "f"), ("th", "f"), ("ing", "in"), ("er", "a"), ("c", "k"), ("k", "c"), ("s", "z"), ("z", "s"), ("f", "ph"), ("i", "e"),
    ("e", "i"), ("a", "u"), ("u", "a"), ("o", "a"), ("t", "d"), ("d", "t"), ("v", "b"), ("b", "v"), ("n", "m"), ("m", "n"), ("g", "j"), ("y", "i"),
)
MIN_CLIPPED = 4
