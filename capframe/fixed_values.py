"""Labels, limits and texts that decide results and must stay as they are."""

# The five classes, in priority order.
CLASSES = ["inside", "outside", "food", "menu", "drink"]

# Caption encoding.
MAX_LEN = 10
MIN_FREQ = 3
PAD_ID = 0
UNK_ID = 1
PAD_WORD = "<pad>"
UNK_WORD = "<unk>"
TOKEN_PATTERN = r"[a-zA-Z]+|[.,!?;:()\-']"

# Split, batches and early stopping.
SEED = 42
BATCH_SIZE = 128
PATIENCE = 10

# Embeddings and losses.
EMB_DIM = 64
NOISE_EPS = 0.1
TEMPERATURE = 0.2
CONTRASTIVE_WEIGHT = 0.05
MODALITY_WEIGHTS = {"image": 1.0, "text": 1.0}
COSINE_FLOOR = 1e-8
IGNORED_LABEL = -100

# Image sizes.
RESIZE_TO = 256
CROP_TO = 224
TRAIN_PADDING = 8

# Generation limits and file-name timestamp.
CLASSIFY_MAX_TOKENS = 16
CAPTION_MAX_TOKENS = 128
TIMESTAMP_FORMAT = "yyyyMMdd_HHmmss"

# The prompts.
CAPTION_PROMPT = "Please generate a concise and accurate caption for this image."

IMAGE_PROMPT = """
You are given an image. 
Your task is to classify the image into exactly one of the following five categories:

inside, outside, food, menu, drink

Definitions:
- inside: indoor restaurant/cafe environment, interior space, tables, chairs, counter, decoration
- outside: exterior view, storefront, street view, outdoor scene
- food: edible food items, dishes, meals, desserts, snacks
- menu: menu board, printed menu, price list, ordering screen
- drink: beverages, cups, coffee, tea, juice, alcohol-free drinks

Important:
Only output one word from this list:
inside, outside, food, menu, drink
Do not explain your answer.
"""

TEXT_PROMPT = """
You are given a caption of an image. 
Your task is to classify the image into exactly one of the following five categories relying solely on its caption:

inside, outside, food, menu, drink

Definitions:
- inside: indoor restaurant/cafe environment, interior space, tables, chairs, counter, decoration
- outside: exterior view, storefront, street view, outdoor scene
- food: edible food items, dishes, meals, desserts, snacks
- menu: menu board, printed menu, price list, ordering screen
- drink: beverages, cups, coffee, tea, juice, alcohol-free drinks

Caption:
{caption}

Important:
Only output one word from this list:
inside, outside, food, menu, drink
Do not explain your answer.
"""

IMAGE_AND_TEXT_PROMPT = """
You are given an image and its caption. 
Your task is to classify the image into exactly one of the following five categories:

inside, outside, food, menu, drink

Definitions:
- inside: indoor restaurant/cafe environment, interior space, tables, chairs, counter, decoration
- outside: exterior view, storefront, street view, outdoor scene
- food: edible food items, dishes, meals, desserts, snacks
- menu: menu board, printed menu, price list, ordering screen
- drink: beverages, cups, coffee, tea, juice, alcohol-free drinks

Caption:
{caption}

Important:
Only output one word from this list:
inside, outside, food, menu, drink
Do not explain your answer.
"""
