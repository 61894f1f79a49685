"""Fixed values that results depend on, stated as the store data defines them."""

# Small categories and the category that takes them in.
CATEGORY_RENAMES = {
    "Art & Design": "Entertainment",
    "Auto & Vehicles": "Lifestyle",
    "Beauty": "Lifestyle",
    "Casino": "Puzzle",
    "Comics": "Entertainment",
    "Dating": "Social",
    "Events": "Social",
    "Food & Drink": "Lifestyle",
    "House & Home": "Lifestyle",
    "Libraries & Demo": "Tools",
    "Music": "Educational",
    "News & Magazines": "Books & Reference",
    "Parenting": "Medical",
    "Shopping": "Lifestyle",
    "Trivia": "Puzzle",
    "Word": "Puzzle",
}

# Game subcategories.
GAME_CATEGORIES = [
    "Action", "Adventure", "Arcade", "Board", "Card", "Casual", "Educational",
    "Puzzle", "Racing", "Role Playing", "Simulation", "Sports", "Strategy",
]

# Category names in number order; 0 is kept for a missing category.
CATEGORIES = [
    "Art & Design", "Auto & Vehicles", "Beauty", "Android Wear", "Books & Reference",
    "Business", "Comics", "Communication", "Dating", "Education", "Entertainment",
    "Events", "Finance", "Food & Drink", "Health & Fitness", "House & Home",
    "Libraries & Demo", "Lifestyle", "Maps & Navigation", "Medical", "Music & Audio",
    "News & Magazines", "Parenting", "Personalization", "Photography", "Productivity",
    "Shopping", "Social", "Sports", "Tools", "Travel & Local",
    "Video Players & Editors", "Weather", "Game",
]
GAME_SUBCATEGORIES = [
    "Action", "Adventure", "Arcade", "Board", "Card", "Casino", "Casual", "Educational",
    "Music", "Puzzle", "Racing", "Role Playing", "Simulation", "Sports", "Strategy",
    "Trivia", "Word",
]
CATEGORY_NUMBERS = {name: i for i, name in enumerate(
    CATEGORIES + [f"Game_{g}" for g in GAME_SUBCATEGORIES], start=1)}

# Upper price of the fixed classes 1 to 3; anything above is class 4.
PRICE_STEPS = [0.99, 1.99, 3.99]

# Install ranges that become one level, and that level.
LARGE_INSTALLS = ["500,000 - 1,000,000", "1,000,000 - 5,000,000", "10,000,000 - 50,000,000"]
LARGE_INSTALLS_LEVEL = "500,000+"
DEFAULT_INSTALLS = "1 - 5"

IN_APP_TEXT = "Offers in-app purchases"
VARIES = "Varies with device"
UNRATED = "Unrated"
NO_REVIEWS = '[{"1":0},{"2":0},{"3":0},{"4":0},{"5":0}]'

# Listings known to be broken in the export.
BROKEN_IDS = [
    "air.com.kongregate.mobile.games.incredibleape.escape",
    "com.dotemu.thelastexpress",
    "rogerfgm.frameextractorex",
    "com.maiko.xscanpet",
]

# Text columns in the order they are joined.
REPORT_TEXT = ["name", "author", "description", "whatsNew", "permissions", "commentsTag",
               "resourcePermissions", "userComments"]
LEARN_TEXT = ["description", "whatsNew"]

# Longest text kept per column.
MAX_LENGTH = {"author": 80, "reviewsPerStarRating": 80, "contentRating": 30}

SIMILAR_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]

# Columns of the feature tables.
ONE_HOT_COLUMNS = ["category", "contentRating", "requiredAndroidVersion_d1",
                   "requiredAndroidVersion_d2", "requiredAndroidVersion_d3", "ranking",
                   "offersInAppPurchases", "installs"]
ONE_HOT_NUMERIC = ["libraries", "totalNrOfReviews", "binarySize"]
SCALED_COLUMNS = ["starRating", "days_since_lastUpdated", "totalNrOfReviews", "libraries",
                  "1_star_reviews", "2_star_reviews", "3_star_reviews", "4_star_reviews",
                  "5_star_reviews", "days_since_release"]
LEARN_NUMERIC = ["starRating", "totalNrOfReviews", "libraries", "bigCompany",
                 "daysSinceLastUpdated", "1starReviews", "2starReviews", "3starReviews",
                 "4starReviews", "5starReviews", "requiredAndroidVersion_major",
                 "requiredAndroidVersion_minor"]

# Parameters of the models kept for the whole set.
FULL_SET_MODELS = {
    "fd_numeric_forest_numeric": dict(kind="forest", features="numeric", trees=75, depth=5),
    "fd_numeric_gradient_numeric": dict(kind="gbt", features="numeric", rate=0.1, trees=150,
                                        depth=5, subset="sqrt"),
    "fd_all_forest_numeric": dict(kind="forest", features="all", trees=50, depth=3),
    "fd_all_gradient_numeric": dict(kind="gbt", features="all", rate=1.0, trees=150, depth=3),
    "fd_text_bnb_text": dict(kind="bernoulli", features="text", min_df=0.25, max_df=0.75,
                             binary=True, smoothing=0.0001),
    "fd_text_gradient_text": dict(kind="gbt", features="text", min_df=0.25, max_df=0.6,
                                  rate=0.1, trees=100, depth=7),
    "fd_text_svm_text": dict(kind="svm", features="text", min_df=0.25, max_df=0.6,
                             cost=10.0, tol=0.01, iterations=1000),
}

# Boosting parameters per category: rate, depth, feature subset, trees.
CATEGORY_MODELS = {
    "ACTION": (0.1, 5, "sqrt", 5),
    "ADVENTURE": (0.01, 5, "all", 150),
    "ARCADE": (0.001, 5, "all", 100),
    "BOARD": (1.0, 5, "sqrt", 100),
    "BOOKS & REFERENCE": (1.0, 5, "all", 75),
    "BUSINESS": (0.01, 5, "sqrt", 10),
    "CARD": (1.0, 3, "all", 100),
    "CASINO": (0.1, 5, "sqrt", 5),
    "CASUAL": (1.0, 5, "sqrt", 10),
    "COMMUNICATION": (1.0, 5, "sqrt", 50),
    "EDUCATION": (0.1, 5, "sqrt", 50),
    "EDUCATIONAL": (0.1, 3, "sqrt", 5),
    "ENTERTAINMENT": (0.01, 5, "sqrt", 100),
    "FINANCE": (0.001, 5, "sqrt", 75),
    "HEALTH & FITNESS": (0.001, 5, "sqrt", 150),
    "LIFESTYLE": (0.1, 3, "all", 10),
    "MAPS & NAVIGATION": (1.0, 3, "all", 10),
    "MEDICAL": (0.1, 3, "sqrt", 5),
    "MUSIC & AUDIO": (0.001, 5, "sqrt", 150),
    "PERSONALIZATION": (0.01, 5, "all", 50),
    "PHOTOGRAPHY": (0.001, 3, "all", 100),
    "PRODUCTIVITY": (0.1, 5, "all", 50),
    "PUZZLE": (0.01, 5, "sqrt", 50),
    "RACING": (0.001, 3, "sqrt", 150),
    "ROLE PLAYING": (0.01, 5, "sqrt", 75),
    "SIMULATION": (0.1, 3, "all", 10),
    "SOCIAL": (0.01, 3, "sqrt", 75),
    "SPORTS": (1.0, 5, "sqrt", 5),
    "STRATEGY": (0.01, 3, "sqrt", 100),
    "TOOLS": (0.001, 3, "all", 150),
    "TRAVEL & LOCAL": (0.1, 5, "all", 5),
    "VIDEO PLAYERS & EDITORS": (0.1, 3, "all", 150),
    "WEATHER": (0.01, 5, "sqrt", 100),
    "WORD": (0.1, 5, "sqrt", 5),
}
# Shared default for a category without an entry.
CATEGORY_MODEL_DEFAULT = (0.1, 3, "sqrt", 5)

# English stop words, the list Spark's StopWordsRemover loads by default.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()
