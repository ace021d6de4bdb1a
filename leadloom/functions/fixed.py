"""Names, hosts, words and patterns that the rules refer to."""

# Marketplace hosts.
MARKETPLACE_HOSTS = (
    "amazon.com amazon.ca amazon.com.mx amazon.com.br amazon.co.uk amazon.de amazon.fr amazon.it amazon.es amazon.nl amazon.se "
    "amazon.pl amazon.com.be amazon.in amazon.co.jp amazon.com.au amazon.sg amazon.ae amazon.sa amazon.com.tr amazon.eg"
).split()

# Free mail domains.
FREE_MAIL = "gmail.com googlemail.com yahoo.com hotmail.com outlook.com aol.com icloud.com mail.com msn.com proton.me protonmail.com".split()

# Mail domains that are no contact of a person.
BLOCKED_MAIL = (
    "1outlets.com abebooks.com amazon.ca amazon.co.uk amazon.com archive.org barnesandnoble.com biblio.com blogger.com blogspot.com "
    "bookbub.com bookshop.org booktopia.com.au booksamillion.com christianbook.com domain.com ebay.com etsy.com example.com "
    "fantasticfiction.co.uk fantasticfiction.com goodreads.com harvard.edu librarything.com litcharts.com loc.gov mit.edu "
    "mitpressbookstore.mit.edu openlibrary.org scholastic.com shopify.com sparknotes.com squarespace.com stanford.edu target.com "
    "template.com walmart.com weebly.com wikipedia.org wikidata.org wix.com wixsite.com wordpress.com worldcat.org yale.edu"
).split()

# Local parts of desks, not persons.
DESKS = "abuse admin administrator billing careers customer feedback help jobs no-reply noreply privacy service support tech technical webmaster".split()

# Fragments of catalog and platform hosts.
PLATFORM_HOSTS = (
    "1outlets. abebooks. academia.edu amazon. anyflip. archive.org audible. barnesandnoble. beenverified. biblio. bookbub. "
    "bookdepository. bookshop. bookstore. booksamillion. booktopia. britannica. calameo. christianbook. clue360. cyberbackgroundchecks. "
    "d-pdf. dokumen. ebay. epub. etsy. facebook. fandom. fantasticfiction. fastpeoplesearch. findpeoplesearch. fliphtml5. free-ebooks. "
    "goodreads. harvard.edu hotmart. infobooks. instagram. instantcheckmate. intelius. issuu. kobo. librarything. linkedin. litcharts. "
    "loc.gov mit.edu mitpressbookstore. mylife. oceanofpdf. onlinebookclub. openlibrary. oujdalibrary. pdfcookie. pdfdrive. peoplebyname. "
    "peoplefinders. pinterest. radaris. readanybook. researchgate. scribd. slideshare. sparknotes. spokeo. stanford.edu target.com "
    "teachingbooks. thriftbooks. tiktok. truepeoplesearch. truthfinder. twitter. usphonebook. walmart.com whitepages. wikiwand. "
    "wikidata. wikipedia. worldcat. x.com yale.edu youtu.be youtube."
).split()

# Social platforms by host fragment, with the class of their links.
SOCIAL_HOSTS = {"instagram.com": "instagram", "facebook.com": "facebook", "tiktok.com": "tiktok", "youtube.com": "youtube", "youtu.be": "youtube", "linkedin.com": "linkedin", "goodreads.com": "goodreads"}

# Patterns of words that make an author a company.
COMPANY_PATTERNS = [
    r"\beditors?\b", r"\beditorial\b", r"\bstaff\b", r"\bdisney\b", r"\bpublishers?\b", r"\bpublishing\b", r"\bpress\b", r"\bimprint\b", r"\binc\.?\b", r"\bllc\.?\b",
    r"\bltd\.?\b", r"\bllp\.?\b", r"\bcorp\.?\b", r"\bcorporation\b", r"\bcompany\b", r"\bco\.", r"\bgmbh\b", r"\bstudios?\b", r"\bproductions?\b", r"\bpublications?\b",
    r"\bmedia\b", r"\bgroup\b", r"\bcollective\b", r"\benterprises?\b", r"\bpartners\b", r"\bassociates\b", r"\bfoundation\b", r"\bministries\b", r"\binstitute\b", r"\bacademy\b",
    r"\bnetwork\b", r"\bteam\b", r"\bmagazine\b", r"\bjournal\b", r"\breview\b", r"\bstore\b", r"\bshop\b", r"\bofficial\b", r"\bbrand\b", r"\bbooks\b",
    r"\bbook club\b", r"\bhouse\b", r"\blibrary\b", r"\bsociety\b", r"\bassociation\b", r"\borganization\b", r"\bcommittee\b", r"\bdepartment\b", r"\buniversity\b", r"\bcollege\b",
    r"\bschool\b", r"\bministry\b", r"\bgovernment\b", r"\bmuseum\b", r"\bgallery\b", r"\bnational geographic\b", r"\bsports illustrated\b", r"\bscholastic\b", r"\bpenguin\b", r"\brandom house\b",
    r"\bharper\s?collins\b", r"\bsimon\s?(?:and|&)\s?schuster\b", r"\bhachette\b", r"\bmacmillan\b", r"\bbloomsbury\b", r"\bcandlewick\b", r"\busborne\b", r"\bchronicle books\b", r"\bworkman\b", r"\bsterling\b",
    r"\bsourcebooks\b", r"\blerner\b", r"\bcapstone\b", r"\bdk\b", r"\bwiley\b", r"\btaschen\b", r"\bphaidon\b", r"\babrams\b", r"\bquarto\b", r"\bhallmark\b",
    r"\blego\b", r"\bmarvel\b", r"\bwarner bros\b", r"\bpixar\b", r"\bnickelodeon\b", r"\bpbs kids\b", r"\bsesame\b",
]
COMPANY_CONSTRUCTION = r"^(?:the\s+)?(?:editors?|staff|team|writers?|contributors?|authors?)\s+(?:of|at|for)\b"

# Traditional publishers.
TRADITIONAL_PUBLISHERS = ["scholastic", "harpercollins", "penguin", "knopf", "viking", "crown", "macmillan", "farrar, straus", "roaring brook", "henry holt", "simon & schuster", "hachette", "little, brown", "orchard", "disney", "candlewick", "chronicle", "bloomsbury"]

# Words at which a person's name ends.
NAME_STOPS = (
    "step techniques paperback hardcover edition ages years amazon stars rating review reviews publisher published today scholastic "
    "instructor presentations empower perfection robot island introduction foreword contributor editor reader series volume vol illustrated "
    "perfect successful successfully sells publishers readers classic stories treasury treasuries complete learning learn hotmart infobooks "
    "pdfdrive epub spokeo whitepages radaris beenverified truthfinder intelius peoplefinders anyflip fliphtml5 scribd slideshare issuu target "
    "walmart linktree publishing imprint books inc llc ltd llp corp corporation company gmbh studios productions publications collective "
    "enterprises partners associates foundation ministries ministry institute academy network magazine journal store shop official brand "
    "society association organization committee department university college museum gallery disney"
).split()
NAME_NOISE = [r"\.\.\.", r"(?i)-\s*Amazon\.com", r"(?i)Amazon\.com", r"(?i)Visit\s+Amazon's\s+", r"(?i)\s+Page", r"(?i)Search\s+results\s+for\s+", r"(?i)acclaimed\s+illustrator\s+", r"(?i)illustrator\s+and\s+author\s+", r"(?i)author\s+and\s+illustrator\s+", r"(?i)\s*\((?:Author|Illustrator|Contributor|Editor|Writer|Translator|Artist)\)"]

# Words left out of author and title tokens, and connectors of title anchors.
AUTHOR_STOPS = "author by dr mr mrs ms prof".split()
TITLE_STOPS = "about amazon and author book books childrens children contact edition for from hardcover kids kindle official paperback picture pictures read reading story stories the website with young".split()
CONNECTORS = "a an the of in on at to and or for with".split()
TITLE_TAIL_STOPS = (
    "step techniques illustration illustrations illustrator illustrators design storytelling visual creative guide masters book books "
    "paperback hardcover edition ages years amazon stars rating review reviews publisher published today scholastic instructor presentations "
    "empower perfection robot island introduction foreword contributor editor reader series volume vol illustrated writing write how to the art "
    "of picture pictures perfect successful successfully sells publishers readers classic stories treasury treasuries complete learning learn "
    "draw drawing paint painting"
).split()

# Local parts by which an author is reached.
AUTHOR_HANDLES = "contact hello info author books press media booking bookings inquiry inquiries writer illustrator studio mail team".split()
ROLE_HINT = r"(?i)\b(contact|email|e-mail|booking|bookings|school visit|school visits|speaking|publicity|publicist|press|media|agent|agency|represented|rights|submissions)\b"
PUBLISHER_HINT = r"(?i)\b(press|publishing|publisher|imprint|publicity|media|literary|agency|booksforkids)\b"
TRUSTED_TYPES = ["contact_page", "official_author_site", "publisher_site", "social_profile", "groq_extraction", "manual"]
OWNED_TYPES = ["official_author_site", "contact_page", "manual"]
EMAIL_FIELDS = ["public_email", "representation_email", "publicist_email"]
CONTACT_FIELDS = [*EMAIL_FIELDS, "public_phone"]
#: Channel and role of each contact field.
FIELD_ROLES = {"public_email": ("email", "author"), "representation_email": ("email", "agent"), "publicist_email": ("email", "publicist"), "public_phone": ("phone", "author")}
#: Ranks by which candidates are chosen.
STATUS_RANK = {"verified": 3, "other": 2, "not_verified": 1}
CHANNEL_RANK = {"email": 2, "phone": 1}
ROLE_RANK = {"author": 4, "agent": 3, "publicist": 2, "other": 1}

# Places outside the target countries, placeholders of addresses, parts of private paths.
FOREIGN = ["united kingdom", "uk", "great britain", "england", "scotland", "wales", "australia", "nz", "new zealand", "india", "germany", "france", "spain", "italy", "pakistan", "pk"]
DUMMY_MAIL = ["example.com", "yourdomain.com", "test.com", "placeholder", "domain.com", "email.com"]
PRIVATE_PATHS = "admin login signin account cart checkout wp-admin dashboard".split()
SCRIPT_HINTS = ["example.com", "domain.com", "email.com", "sentry", "wixpress", "schema.org"]
SCRIPT_WINDOW = ["function", "var ", "const ", "schema", "sentry", "javascript"]

# Terms of topics.
CHILD_TERMS = ["children", "kids", "picture book", "bedtime", "storybook", "juvenile", "early reader"]
PICTURE_TERMS = ["picture book", "illustrated", "illustrator", "coloring", "storybook"]
TOPIC_HINTS = ["children", "child", "kids", "picture book", "illustrated", "juvenile", "storybook", "bedtime", "early reader", "preschool"]
LISTING_TERMS = ["children", "kids", "picture book", "paperback", "book"]
ANIMATED_TERMS = ["animated", "animation", "motion graphics"]
READ_ALOUD_TERMS = ["read aloud", "read-aloud", "storytime"]
SOURCE_SCORES = {"open_library": 0.24, "google_books": 0.24, "library_of_congress": 0.22, "crossref": 0.22, "amazon": 0.22, "internet_archive": 0.18, "ddgs": 0.14, "ddgs_html": 0.12, "bing_html": 0.12}
VIDEO_STATUSES = ["not_checked", "no_public_video_found", "found_trailer", "found_animated_video", "found_read_aloud_only", "unclear"]

# Numbering plans. Country code, region, trunk prefix, and by leading digits of the national number its kind and lengths.
NUMBER_PLANS = [
    ("1", "US", "1", [("2", "landline", 10, 10), ("3", "landline", 10, 10), ("4", "landline", 10, 10), ("5", "landline", 10, 10), ("6", "landline", 10, 10), ("7", "landline", 10, 10), ("8", "landline", 10, 10), ("9", "landline", 10, 10),
                      ("800", "toll_free", 10, 10), ("833", "toll_free", 10, 10), ("844", "toll_free", 10, 10), ("855", "toll_free", 10, 10), ("866", "toll_free", 10, 10), ("877", "toll_free", 10, 10), ("888", "toll_free", 10, 10), ("900", "premium_rate", 10, 10)]),
    ("44", "GB", "0", [("1", "landline", 9, 10), ("2", "landline", 10, 10), ("3", "shared", 10, 10), ("7", "mobile", 10, 10), ("70", "personal", 10, 10), ("800", "toll_free", 7, 10), ("808", "toll_free", 10, 10), ("84", "shared", 7, 10), ("87", "shared", 10, 10), ("9", "premium_rate", 10, 10)]),
    ("33", "FR", "0", [("1", "landline", 9, 9), ("2", "landline", 9, 9), ("3", "landline", 9, 9), ("4", "landline", 9, 9), ("5", "landline", 9, 9), ("6", "mobile", 9, 9), ("7", "mobile", 9, 9), ("80", "toll_free", 9, 9), ("89", "premium_rate", 9, 9), ("9", "voip", 9, 9)]),
    ("34", "ES", "", [("6", "mobile", 9, 9), ("7", "mobile", 9, 9), ("8", "landline", 9, 9), ("9", "landline", 9, 9), ("800", "toll_free", 9, 9), ("900", "toll_free", 9, 9), ("803", "premium_rate", 9, 9), ("806", "premium_rate", 9, 9), ("807", "premium_rate", 9, 9)]),
    ("49", "DE", "0", [("2", "landline", 6, 11), ("3", "landline", 6, 11), ("4", "landline", 6, 11), ("5", "landline", 6, 11), ("6", "landline", 6, 11), ("7", "landline", 6, 11), ("8", "landline", 6, 11), ("9", "landline", 6, 11), ("15", "mobile", 10, 11), ("16", "mobile", 10, 11), ("17", "mobile", 10, 11), ("800", "toll_free", 10, 10), ("900", "premium_rate", 10, 10)]),
    ("61", "AU", "0", [("2", "landline", 9, 9), ("3", "landline", 9, 9), ("4", "mobile", 9, 9), ("7", "landline", 9, 9), ("8", "landline", 9, 9), ("1800", "toll_free", 10, 10), ("190", "premium_rate", 10, 10)]),
]

# Public suffixes of two labels; all others are taken as one label.
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz net.nz org.nz govt.nz ac.nz co.jp "
    "ne.jp or.jp ac.jp go.jp com.br net.br org.br gov.br com.mx org.mx com.tr org.tr com.be co.in net.in org.in gov.in ac.in co.za org.za com.sg "
    "com.hk com.tw com.cn net.cn org.cn gov.cn co.kr or.kr com.ar com.co com.pe com.pk com.ph com.my com.ua co.il org.il com.eg com.sa co.id"
).split()

# Canonical fields of imports, with their header aliases in order of preference.
HEADER_ALIASES = {
    "title": ["title", "book_title", "name", "book name", "book project", "book / project"],
    "author_name": ["author", "author_name", "author owner", "author / owner", "author / owner name", "author owner name"],
    "illustrator_name": ["illustrator", "illustrator_name"],
    "amazon_book_url": ["amazon_url", "amazon_book_url", "link", "amazon product url", "amazon book url", "amazon / book url", "amazon url", "amazon book / author url", "amazon book author url", "amazon / author url"],
    "asin": ["asin"],
    "category": ["category"],
    "review_count": ["review_count", "no_of_ratings"],
    "rating": ["rating", "rating_out_of_5"],
    "publisher": ["publisher", "publisher imprint"],
    "publication_date": ["publication_date", "publication date"],
    "cover_image_url": ["cover_image_url"],
    "author_website": ["author_website", "author website", "official website", "website"],
    "contact_page_url": ["contact_page_url", "contact page url", "contact url", "contact form", "proof url", "email proof url", "email proof"],
    "public_email": ["public_email", "primary_email", "primary email", "email", "email address"],
    "representation_email": ["representation_email", "secondary_email", "secondary email", "agent email"],
    "publicist_email": ["publicist_email", "publicist email"],
    "public_phone": ["public_phone", "phone", "phone number", "phone dial format"],
    "public_email_source_url": ["public_email_source_url", "email source url", "email_source_url", "email proof url", "email proof"],
    "public_phone_source_url": ["public_phone_source_url", "phone source url", "phone_source_url", "phone proof url", "phone proof"],
    "verification_status": ["verification_status", "verification level", "lead quality status", "lead quality", "quality status"],
    "verification_score": ["verification_score"],
    "video_status": ["video_status"],
    "video_confidence": ["video_confidence"],
    "lead_score": ["lead_score"],
    "do_not_contact": ["do_not_contact", "dnc"],
    "location": ["location", "region", "phone country / region", "phone country region", "country"],
    "agent_name": ["agent_name", "agent name"],
    "publisher_url": ["publisher_url", "publisher url"],
    "instagram_url": ["instagram_url", "instagram url"],
    "facebook_url": ["facebook_url", "facebook url"],
    "tiktok_url": ["tiktok_url", "tiktok url"],
    "youtube_url": ["youtube_url", "youtube url"],
    "linkedin_url": ["linkedin_url", "linkedin url"],
    "sales_agent_summary": ["sales_agent_summary", "why this lead fits", "owner contact rationale", "contact rationale"],
    "suggested_first_line": ["suggested_first_line", "recommended first touch"],
    "suggested_pitch_angle": ["suggested_pitch_angle", "best fit bsp service"],
    "notes": ["notes"],
}
#: Parts of names that an export does not take for an author's.
EXPORT_NAME_STOPS = ["amazon", "unknown", "this item", "paperback", "kindle", "audible", "academy award", "best seller", "children's books", "book series"]
#: Marks of sign-in, captcha and shop pages among search results.
ACCESS_WALLS = ["amazon sign-in", "sign in to amazon", "amazon captcha", "robot check", "not a robot", "enter the characters", "amazon.com: books", "amazon.com books"]
#: Messages of the export's gate, in their order.
EXPORT_ERRORS = [
    "author_name is not a usable personal/pen name",
    "amazon_book_url is missing or not normalized",
    "missing public email or phone",
    "public_email failed syntax validation",
    "contact source did not pass relevance/confidence checks",
    "lead is marked do-not-contact",
    "contact has not passed every verification hard gate",
]

#: Searches for an author's site, contact and social pages, by purpose; {pair} is the quoted author with the quoted anchor of
#: the title, {tail} a space and the quoted anchor (both without anchor where the title is blank).
AUTHOR_SEARCHES = {
    "site": [
        "{pair} author website",
        '"{author}" official author website',
        "{pair} official site",
        '"{author}" children\'s picture book author website',
        "{pair} publisher",
        '"{author}" author-illustrator website',
        '"{author}" writes and illustrates',
        "{pair} author page publisher",
    ],
    "contact": [
        "{pair} contact",
        '"{author}" author contact email',
        '"{author}" school visits booking contact',
        "{pair} media kit",
        '"{author}" picture book author contact',
        '"{author}" press kit author contact',
        '"{author}" booking school visit author',
        "{pair} get in touch",
    ],
    "social": [
        'site:instagram.com "{author}"{tail}',
        'site:facebook.com "{author}"{tail}',
        'site:youtube.com "{author}"{tail}',
        'site:linkedin.com "{author}"{tail}',
        'site:tiktok.com "{author}"{tail}',
        '"{author}"{tail} linktree OR linktr.ee OR bio.site',
        "{pair} book trailer",
        "{pair} interview author",
    ],
}
#: Further searches for a contact.
DEEP_SEARCHES = [
    '"{author}" official website',
    '"{author}" author website contact',
    "{pair} official website",
    "{pair} contact email",
    '"{author}" children\'s author contact email',
    '"{author}" picture book author contact',
    '"{author}" school visits booking contact',
    '"{author}" media kit contact',
    '"{author}" email "@gmail.com" OR "@yahoo.com" OR "@outlook.com"',
    '"{author}" ("agent" OR "agency" OR "represented by") contact',
    '"{author}" ("publicist" OR "publicity" OR "press" OR "media") email',
    '"{author}" contact page',
    'site:linktr.ee OR site:bio.site OR site:carrd.co OR site:beacons.ai "{author}"',
    'site:substack.com "{author}" children book',
    '"{author}" ("media kit" OR "press kit") author',
    '"{author}" author ("email me" OR "reach me" OR "get in touch")',
    '"{author}" illustrator author contact booking',
    "{pair} author visit booking",
]
#: Searches for videos of a book.
VIDEO_SEARCHES = [
    '"{title}" "{author}" book trailer',
    '"{title}" "{author}" animated trailer',
    '"{title}" "{author}" animation',
    '"{title}" "{author}" animated book',
    '"{title}" "{author}" read aloud',
    '"{author}" children\'s book trailer',
    '"{title}" children book trailer',
]
#: Headings and labels of a brief, in their order; a list of (label, fields of which the first present one is shown).
BRIEF = [
    ("Quick Summary", ["{sales_agent_summary}"]),
    ("Book", ["- Title: {title}", "- Author: {author_name}", "- Amazon URL: {amazon_book_url|Missing}", "- ASIN: {asin|Missing}", "- Category: {category|Missing}", "- Publisher: {publisher|Missing}"]),
    ("Why This Lead Matters", ["{fit_reason}"]),
    ("Video Opportunity", ["Status: {video_text}", "Evidence: Source-linked video/search evidence is listed in the lead record.", "Safe wording: I did not find a public book trailer in the sources I checked."]),
    ("Contact Path", ["- Best contact: {public_email|public_phone|Missing}", "- Backup contact: {contact_page_url|Missing}", "- Website: {canonical_website|Missing}", "- Social: {instagram_url|facebook_url|Missing}"]),
    ("Confidence", ["- Book confidence: {book_data_confidence}", "- Author identity confidence: {identity_confidence|0}", "- Contact confidence: {extraction_confidence}", "- Video confidence: {video_confidence}"]),
    ("Recommended Pitch Angle", ["{suggested_pitch_angle}"]),
    ("Suggested First Line", ["{suggested_first_line}"]),
    ("What To Say", ["- {what_to_say}"]),
    ("What Not To Say", ["- {what_not_to_say}"]),
]
NO_VIDEO = "No public video found in searched sources."
#: Names of video statuses in texts.
VIDEO_LABELS = {
    "not_checked": "Not checked",
    "found_trailer": "Found trailer",
    "found_animated_video": "Found animated video",
    "found_read_aloud_only": "Found read aloud only",
    "unclear": "Unclear",
    "no_public_video_found": "No public video found",
}

#: Paths, marks (classes) and patterns of a project directory's pages.
PROJECT_PATH = r"^/project/[^/?#]+-\d+/?$"
PROJECT_MARKS = "public-project-title public-project-credit user-profile-card user-profile-social profile-social public-project-synopsis public-project-review project-review public-project-description book-description review-section".split()
PROJECT_TEXTS = ["public-project-synopsis", "public-project-review p", "project-review p", "public-project-description", "book-description", "review-section p"]
PROJECT_TITLE_TAIL = r"(?i)\s+by\s+.+?\s*\|\s*\w+$"
PROJECT_AUTHORS = [r"\bby\s+([A-Z][A-Za-z0-9 ,'&-]{2,80})(?:[.;|]|\s{2,}|$)", r"\bAuthor\s*[:\-]\s*([A-Z][A-Za-z0-9 ,'&-]{2,80})(?:[.;|]|\s{2,}|$)"]

# ---- fixed values: pages whose contacts a batch doesn't take, hints of an official page, addresses that are nobody's ----
CONTACT_BLOCKED_DOMAINS = (
    "amazon.com awesomebooks.com kdp.amazon.com goodreads.com barnesandnoble.com beenverified.com biblio.com books.google.com booktopia.com.au booksamillion.com christianbook.com "
    "youtube.com youtu.be facebook.com instagram.com tiktok.com x.com twitter.com linkedin.com pubmed.ncbi.nlm.nih.gov whitepages.com wordpress.com"
).split()
CONTACT_BLOCKED_PARTS = [".cdn.", "digitaloceanspaces.com", "review", "news", "chronicle", "peoplefinders", "radaris", "spokeo", "truepeoplesearch"]
OFFICIAL_PAGE_HINTS = ["about", "author", "book", "contact", "school", "visit", "media", "press"]
CONTACT_UNUSABLE = ["example.", "domain.", "sentry", "privacy@", "support@"]

# ---- fixed values: parts of names that are nobody to write to, and domains whose pages vouch for no contact ----
OUTREACH_NAME_STOPS = "amazon books children illustrated publishing publisher calendar library school story university press bookshop bookstore at-a-glance".split()
GENERIC_CONTACT_DOMAINS = (
    "amazon.com archive.org audible.com barnesandnoble.com booktopia.com.au booksamillion.com goodreads.com kdp.amazon.com youtube.com youtu.be facebook.com instagram.com tiktok.com "
    "linkedin.com mitpressbookstore.mit.edu openlibrary.org worldcat.org"
).split()
