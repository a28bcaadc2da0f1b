"""Word lists, patterns and registries that results depend on."""

from __future__ import annotations

# Words that say nothing about a paper's subject.
BANNED_WORDS = """
method methods approach approaches technique techniques result results performance paper papers study studies novel new proposed propose
present presents introduction conclusion abstract work works research analysis experiment experiments evaluation evaluations model models
network networks system systems algorithm algorithms framework frameworks data dataset datasets benchmark benchmarks training testing
learning task tasks based using via improved better best efficient effective simple complex large small high low state art end show shows
demonstrate demonstrates achieve achieves outperform outperforms improve improves
""".split() + ["end to end"]

# English stop words.
STOPWORDS = """
a an the and or but if then else when at by for with about against between into through during before after above below to from up down in
out on off over under again further once here there all each few more most other some such no nor not only own same so than too very can
will just should now also however thus therefore hence although whereas while since because as is are was were be been being have has had
having do does did doing would could might may must shall i you he she it we they what which who whom this that these those am
""".split()

# Words of the field that are no subject.
DOMAIN_NOISE = """
experiments experimental ablation ablations comparison comparisons baseline baselines dataset datasets benchmark benchmarks samples sample
examples example accuracy loss metrics metric score scores table figure figures tables problem problems solution solutions challenge
challenges issue issues application applications
""".split()

# Spellings of one subject.
SYNONYMS = {
    "llm": "large language model",
    "llms": "large language model",
    "large language models": "large language model",
    "diffusion models": "diffusion model",
    "diffusion based": "diffusion model",
    "transformers": "transformer",
    "vision transformer": "vision transformer",
    "vision transformers": "vision transformer",
    "vit": "vision transformer",
    "vits": "vision transformer",
    "gans": "generative adversarial network",
    "gan": "generative adversarial network",
    "generative adversarial networks": "generative adversarial network",
    "cnn": "convolutional neural network",
    "cnns": "convolutional neural network",
    "convolutional neural networks": "convolutional neural network",
    "rnn": "recurrent neural network",
    "rnns": "recurrent neural network",
    "recurrent neural networks": "recurrent neural network",
    "lstm": "long short term memory",
    "lstms": "long short term memory",
    "rl": "reinforcement learning",
    "drl": "deep reinforcement learning",
    "self supervised": "self supervised learning",
    "self supervision": "self supervised learning",
    "contrastive": "contrastive learning",
    "nlp": "natural language processing",
    "cv": "computer vision",
    "ml": "machine learning",
    "dl": "deep learning",
    "ai": "artificial intelligence",
}

# Words that a title's token frequencies leave out.
TITLE_STOPWORDS = """
a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may must
can this that these those it its as we our their your paper study analysis approach method methods model models learning network networks
neural deep data using via based novel new towards propose proposed present show demonstrate introduce framework system algorithm technique
techniques
""".split()

# Patterns of venue names, in order of precedence; any case.
VENUE_PATTERNS = [
    ("ICML", [r"\bICML\b", r"International Conference on Machine Learning"]),
    ("NeurIPS", [r"\bNeurIPS\b", r"\bNIPS\b", r"Neural Information Processing"]),
    ("ICLR", [r"\bICLR\b", r"International Conference on Learning Representations"]),
    ("CVPR", [r"\bCVPR\b", r"Computer Vision and Pattern Recognition"]),
    ("ICCV", [r"\bICCV\b", r"International Conference on Computer Vision"]),
    ("ECCV", [r"\bECCV\b", r"European Conference on Computer Vision"]),
    ("ACL", [r"\bACL\s*20\d{2}\b", r"Annual Meeting of the Association for Computational Linguistics"]),
    ("EMNLP", [r"\bEMNLP\b", r"Empirical Methods in Natural Language Processing"]),
    ("NAACL", [r"\bNAACL\b", r"North American.*ACL"]),
    ("AAAI", [r"\bAAAI\b", r"AAAI Conference on Artificial Intelligence"]),
    ("IJCAI", [r"\bIJCAI\b", r"International Joint Conference on Artificial Intelligence"]),
    ("CoRL", [r"\bCoRL\b", r"Conference on Robot Learning"]),
    ("AISTATS", [r"\bAISTATS\b", r"Artificial Intelligence and Statistics"]),
]

# Venues whose names a year may follow, in order of precedence, and their long names if they count.
VENUES_WITH_YEAR = [
    ("NeurIPS", "Neural Information Processing Systems"),
    ("ICLR", "International Conference on Learning Representations"),
    ("ICML", "International Conference on Machine Learning"),
    ("CVPR", "Computer Vision and Pattern Recognition"),
    ("ICCV", "International Conference on Computer Vision"),
    ("ECCV", "European Conference on Computer Vision"),
    ("ACL", "Association for Computational Linguistics"),
    ("EMNLP", None),
    ("NAACL", None),
    ("AAAI", None),
    ("IJCAI", None),
    ("CoRL", None),
    ("AISTATS", None),
]

# Phrases of each domain, in order of precedence.
DOMAIN_PHRASES = [
    ("CV", ["cs.CV", "computer vision", "image", "video", "visual"]),
    ("NLP", ["cs.CL", "natural language", "nlp", "text", "language model"]),
    ("ML", ["cs.LG", "stat.ML", "machine learning", "deep learning"]),
    ("RL", ["cs.AI", "reinforcement learning", "robot", "control"]),
    ("AI", ["artificial intelligence", "neural network"]),
]

# Phrases of a venue id or name by domain, in order of precedence.
VENUE_DOMAINS = [
    ("ML", ["machine learning", "learning representations", "neural information", "ICLR", "NeurIPS", "ICML", "AISTATS", "AutoML"]),
    ("NLP", ["natural language", "computational linguistics", "language model", "ACL", "EMNLP", "NAACL", "COLING", "COLM", "ARR"]),
    ("CV", ["computer vision", "visual", "image", "video", "CVPR", "ICCV", "ECCV", "3DV"]),
    ("RL", ["reinforcement learning", "robot", "control", "autonomous", "CoRL", "RLC", "ICRA"]),
    ("Theory", ["learning theory", "algorithmic", "computational learning", "COLT", "ALT", "UAI"]),
    ("Graphics", ["graphics", "siggraph", "rendering", "animation", "SIGGRAPH"]),
    ("Data", ["data mining", "knowledge discovery", "database", "KDD", "SIGMOD", "VLDB"]),
]

# Tiers of venues; all others are C.
VENUE_TIERS = {
    "A": ["ICLR", "NeurIPS", "ICML", "ACL", "EMNLP", "NAACL", "CVPR", "ICCV", "ECCV", "AAAI", "IJCAI", "SIGGRAPH"],
    "B": ["AISTATS", "UAI", "COLT", "ALT", "CoRL", "COLING", "COLM", "LOG", "RLC"],
}

# Full names of venues.
VENUE_FULL_NAMES = {
    "ICLR": "International Conference on Learning Representations",
    "NeurIPS": "Conference on Neural Information Processing Systems",
    "ICML": "International Conference on Machine Learning",
    "ACL": "Annual Meeting of the Association for Computational Linguistics",
    "EMNLP": "Conference on Empirical Methods in Natural Language Processing",
    "NAACL": "North American Chapter of the ACL",
    "CVPR": "Conference on Computer Vision and Pattern Recognition",
    "COLING": "International Conference on Computational Linguistics",
    "COLM": "Conference on Language Modeling",
    "AISTATS": "International Conference on AI and Statistics",
    "CoRL": "Conference on Robot Learning",
    "UAI": "Conference on Uncertainty in Artificial Intelligence",
    "COLT": "Conference on Learning Theory",
    "LOG": "Learning on Graphs Conference",
    "AAAI": "AAAI Conference on Artificial Intelligence",
    "IJCAI": "International Joint Conference on AI",
    "SIGGRAPH": "ACM SIGGRAPH Conference",
}

# The venues of the static registry, with the years collected.
REGISTRY = {
    "ICLR": ("ML", [2025, 2024, 2023, 2022, 2021]),
    "NeurIPS": ("ML", [2024, 2023, 2022, 2021]),
    "ICML": ("ML", [2024, 2023, 2022, 2021]),
    "EMNLP": ("NLP", [2024, 2023]),
    "COLM": ("NLP", [2024]),
    "CoRL": ("RL", [2024, 2023, 2022]),
    "LOG": ("ML", [2024, 2023, 2022]),
    "AISTATS": ("ML", [2024, 2023, 2022]),
}

# Fixed value: sources in the order in which a batch is structured.
SOURCE_ORDER = ["openreview", "arxiv", "openalex", "s2"]
