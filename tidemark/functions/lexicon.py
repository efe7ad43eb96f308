"""Word lists and patterns of the rule-based operators, in the syntax that Java's regular expressions share with Python's.

Fixed values: results depend on each of them as it stands.
"""

COMPLAINT = (
    r"(?i)\b(?:but|however|although|though|except|unfortunately|sadly|regrettably|despite|nevertheless|yet(?=\s+[^,.])|"
    r"cracked|broke|broken|shattered|leaked|leaking|spilled|exploded|jammed|stuck|clogged|blocked|stripped|peeled|"
    r"burning|burns|burned|stinging|stings|stung|itching|itchy|rash|hives|dermatitis|allergic|allergy|breakout|cystic|"
    r"irritation|irritated|inflamed|redness|swelling|blisters|terrible|horrible|awful|worst|useless|waste|disappointed|"
    r"doesn't work|didn't work|not work|stopped working|expired|smells off|changed formula|no effect|no results|zero effect|"
    r"crash|crashes|crashed|freeze|freezes|frozen|failed|fails|failure|glitch|limbo|pending|not loading|times out|timed out|"
    r"timeout|redirect loop|login loop|unresponsive|memory leak|deadlock|never arrived|defective)\b"
)
PURE_MARKERS = ("but", "however", "although", "though", "except", "until", "despite", "nevertheless", "yet", "then", "while", "whereas")
WEAK_TRIGGER = (
    r"(?i)\b(?:return(?!\s+to\b)|returns(?!\s+to\b)|returned(?!\s+to\b)|returning(?!\s+to\b)|refund|refunded|replacement|"
    r"exchange(?!\s+for\s+(?:an?\s+)?(?:honest|unbiased|complimentary|free|my|this)\b)|money back|fake|fakes|counterfeit|knockoff|"
    r"error|errors|bug|bugs|damaged|recalled|recall)\b"
)
WEAK_CONTEXT = (
    r"(?i)\b(?:can't|cannot|couldn't|could not|won't|will not|never arrived|waiting|waited|refuse|refused|refusing|denied|deny|"
    r"broken|damaged|defective|cracked|leaked|jammed|terrible|horrible|awful|worst|useless|disappointed|angry|furious|unusable|immediately)\b"
)
PROMOTION = (
    r"(?i)\b(?:in exchange for (?:an? )?(?:honest|unbiased|free|complimentary) review|received (?:this )?(?:product )?(?:complimentary|free)|"
    r"complimentary from \w+|gifted by \w+|influenster|trywithtopbox|bzzagent|pr package)\b"
)
EXPLICIT_DEFECT = (
    r"(?i)\b(?:cracked|broke|broken|shattered|leaked|leaking|spilled|exploded|jammed|stuck|clogged|burning|burns|burned|stinging|stings|stung|"
    r"itching|itchy|rash|hives|dermatitis|allergic|allergy|cystic|blisters|crash|crashes|crashed|freeze|freezes|frozen)\b"
)
RECOMMENDATION = (
    r"(?i)\b(?:would (?:love|like|want|prefer|suggest|recommend)|wish (?:it|they|you)|hope (?:they|you|it)|"
    r"should (?:add|include|have|make|create|offer|provide)|please (?:add|make|consider|include|fix|release|offer)|"
    r"it would be (?:great|nice|better|amazing|helpful|perfect) if|(?:add|include|offer|create|release|make)\s+(?:a|an|more|some|the)\s+\w+|"
    r"feature request|improvement|suggestion|could (?:add|include|improve|offer)|next version|future (?:update|version|release)|"
    r"needs? (?:to be|a|an|more)\s+)\b"
)
RECOMMENDATION_SIGNALS = (
    r"(?i)\b(?:would\s+(?:love|like|want|prefer|suggest|recommend)|wish\s+(?:it|they|you)|hope\s+(?:they|you|it)|"
    r"should\s+(?:add|include|have|make|create|offer|provide|fix)|please\s+(?:add|make|consider|include|fix|release|offer)|"
    r"it\s+would\s+be\s+(?:great|nice|better|amazing|helpful|perfect)\s+if|feature\s+request|suggestion|could\s+(?:add|include|improve|offer))\b"
)
PRAISE = (
    r"(?i)\b(?:love|favorite|favourite|holy grail|best (?:product|cream|serum|moisturizer|cleanser|purchase|ever|app|feature|\w+)|"
    r"amazing|amazed|incredibly hydrating|so smooth|smooth|soft|glowing|glow|cleared my skin|gentle|works wonders|fantastic|blazingly fast|"
    r"super intuitive|perfect|absorbs (?:instantly|quickly|well)|10/10|five stars|5 stars|outstanding|flawless|super soft|worth every penny|"
    r"highly recommend|excellent|wonderful|superb|brilliant|awesome|obsessed|staple|so good|really good|game changer|hydrating|refreshing|"
    r"soothing|leaves skin|feels great|smells amazing|smells great)\b"
)
NEGATIONS = (
    r"never|didn'?t|did not|not|no|wasn'?t|was not|isn'?t|is not|doesn'?t|does not|without|zero|barely|hardly|scarcely|won'?t|wont|can'?t|cant|"
    r"cannot|couldn'?t|couldnt"
)
MITIGATIONS = (
    r"stop(?:ped|s)?|decrease in|decreased|prevented|prevents|removes?|reduces?|soothes?|clears?|cures?|calms?|won'?t|wont|relieves?"
)
SYMPTOMS = (
    r"irritat\w*|burn\w*|break\s*out\w*|breakout\w*|acne|rash\w*|peel\w*|sting\w*|pill\w*|problem\w*|issue\w*|defect\w*|clog\w*|leak\w*|dry\w*|"
    r"crash\w*|shrink\w*|strip\w*|redness|tight\w*|puffiness|wrinkle\w*|greas\w*|stick\w*|residue|disappoint\w*|bad|worst|terrible|horrible|"
    r"awful|waste|harsh|heavy"
)
NEGATED = (
    rf"(?i)\b(?:{NEGATIONS})\b(?:\s+\w+){{0,8}}\s+(?:{SYMPTOMS})|\b(?:{SYMPTOMS})\b(?:\s+\w+){{0,8}}\s+(?:{NEGATIONS})\b|"
    rf"\b(?:{MITIGATIONS})\b(?:\s+\w+){{0,8}}\s+(?:{SYMPTOMS})"
)
FAILED_MITIGATION = rf"(?i)\b(?:{NEGATIONS})\b(?:\s+\w+){{0,4}}\s+(?:{MITIGATIONS})"
RESOLVED = (
    r"(?i)\b(?:works? (?:fine|great|well|perfectly)|no (?:issues?|problems?)|all (?:good|set|sorted|resolved|fixed)|"
    r"(?:already )?(?:sorted|resolved|fixed|processed|handled|replaced|refunded)|happy with)\b"
)
CLAUSE_END = (
    r"(?i)\s*(?:[,;:.!?]|[—–]|\bbut\b|\bhowever\b|\balthough\b|\bthough\b|\bexcept\b|\byet\b|\bwhereas\b|\bwhile\b|\bdespite\b|\bthen\b)\s*"
)
CONTRAST = (
    r"(?i)\b(but|however|except\s+that|except|although|though|unfortunately|sadly|regrettably|despite|nevertheless|yet|until)\b"
)
P0 = (
    r"(?i)\b(?:burning|burns|burned|stinging|stings|stung|itching|itchy|rash|hives|dermatitis|allergic|allergy|blisters?|swollen|swelling|"
    r"chemical\s+burn|crash|crashes|crashed|freeze|freezes|frozen|black\s+screen|login\s+loop|biometric\s+loop|money\s+stuck|double\s+charged|"
    r"unauthorized\s+charge|fatal\s+error)\b"
)
P1 = (
    r"(?i)\b(?:cracked|broken|shattered|leaked|leaking|spilled|exploded|jammed|stuck|clogged|blocked|stripped|peeled|pump\s+broke|dispenser\s+broke|"
    r"dropper\s+cracked|spray\s+nozzle|seal\s+broken|half\s+empty|failed|fails|failure|error|bug|bugs|glitch|limbo|pending|timeout|not\s+loading|"
    r"cannot\s+open|won't\s+open|white\s+screen|data\s+loss|sync\s+failed)\b"
)
P2 = (
    r"(?i)\b(?:terrible|horrible|awful|worst|useless|waste|disappointed|disappointing|doesn't\s+work|didn't\s+work|stopped\s+working|smells\s+off|"
    r"changed\s+formula|greasy|sticky|chalky|dryness|drying|flaking|slow|laggy|sluggish|battery\s+drain|overheats|heating\s+up|poor\s+quality)\b"
)
SENTENCE_END = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<!\bv\d)(?<!\bDr)(?<!\bMr)(?<!\bMs)(?<!\bNo)(?<=\.|\?|!)\s+"
SPAN_END = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<!\bv\d)(?<!\bDr)(?<!\bMr)(?<=\.|\?|!)(?:\s+|$)|[\r\n]+"

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
ORDER_PREFIX = r"(?i:\b#?(?:ORD|ORDER|TRK|TRACK|REF|INVOICE|PO|AWB|RMA)[-_:#]?\s*)"
CARD = r"(?<![\d])(?:\d[ \-]?){12,18}\d(?![\d])"
PHONE_LABEL = (
    r"(?i)\b(?:phone|tel|telephone|mobile|cell|contact|whatsapp|call|reach\s+me\s+at|reach\s+us\s+at|contact\s+me\s+at|call\s+me\s+(?:at|on)|"
    r"call\s+us\s+(?:at|on)|talk\s+to|message\s+me\s+at|text\s+me\s+at|write\s+to|email\s+me\s+at)\b\s*(?:(?:number|no\.?|#)?\s*[:#-]?\s*)"
)
PHONE_NUMBER = r"\+?\d[\d\s\-().]{6,17}\d"
PHONE_E164 = r"(?<![\d.])\+\d{9,14}(?![\d.])"
PHONE_TEN = r"(?<![\d.\-])\(?\d{3}\)?[ \-.]?\d{3}[ \-.]?\d{4}(?![\d.\-])"
PIN = r"(?i)(\b(?:pin(?:code)?|zip(?:code)?|postal(?:\s+code)?)\s*[:#-]?\s*)(\d{5,6})\b"
NAME_FRAME = (
    r"(?i:my\s+name\s+is|name\s+is|full\s+name|customer\s+name|customer|buyer|account\s+holder|signed|regards|sincerely|best\s+regards|"
    r"yours\s+(?:sincerely|truly|faithfully))\s*[,:]?\s*"
)
NAME = r"[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20})?"
ENTITIES = ("ORDER_ID", "PAYMENT_CARD", "EMAIL", "PHONE", "POSTAL_CODE", "PERSON_NAME")

SENTINELS = ("nan", "null", "none", "n/a", "undefined")
FILLERS = (
    "nan", "null", "none", "n/a", "na", "nil", "undefined", "ok", "good", "bad", "yes", "no", "test", "testing",
    "asdf", "qwerty", "...", "???", "---", "***", "no comment",
)

CANDIDATES = {
    "review_text": ("review_text", "review", "text", "comment", "feedback", "customer_review", "body", "content", "message", "verbatim", "complaint", "notes", "description", "opinion", "user_review", "user_feedback", "review_body", "full_review", "critique"),
    "rating": ("rating", "score", "stars", "star_rating", "grade", "val", "rate", "user_rating", "review_rating", "star", "satisfaction"),
    "batch_or_version": ("version", "batch", "release", "app_version", "build", "lot", "manufacturing_lot", "cohort", "quarter", "revision", "app_release", "batch_number", "lot_number", "software_version", "model_version"),
    "sku_or_module": ("sku", "module", "feature", "category", "component", "subsystem", "feature_area", "service", "item_code", "sku_id", "product_id", "tag", "topic", "department"),
    "product_name": ("product_name", "product", "item", "item_name", "app_name", "brand", "brand_name", "title", "application", "device"),
    "channel": ("channel", "source", "platform", "store", "app_store", "origin", "marketplace", "device_type", "os", "client"),
    "created_at": ("timestamp", "created_at", "date", "submission_time", "time", "review_date", "created_date", "datetime", "published_at", "post_date", "submitted_at"),
}
TEXT_EXCLUSIONS = (r"_?id$", r"^id$", r"url$", r"link$", r"count$", r"score$", r"length$", r"date$", r"time$", r"rating$", r"author$", r"name$")
