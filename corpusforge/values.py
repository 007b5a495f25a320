"""Constants shared by the operators."""

# Special tokens in vocabulary order, then the spare ones.
SPECIAL_TOKENS = [
    "<pad>",
    "<s>",
    "</s>",
    "<usr>",
    "<sys>",
    "<unk>",
    "<mask>",
    "<|endoftext|>",
] + [f"<unused{i}>" for i in range(1, 65)]

# Tokenizer and block settings.
VOCAB_SIZE = 51200
MIN_FREQUENCY = 5
BLOCK_SIZE = 1024

# Fixed value: a label that carries no loss.
IGNORE_LABEL = -100

# Text columns by priority, for corpora, downloads and tokenizer input.
TEXT_COLUMNS = ["sentence", "dialog", "spoken", "document", "form", "content"]
DOWNLOAD_TEXT_COLUMNS = ["sentence", "dialog", "spoken", "content", "form"]
TOKENIZER_TEXT_COLUMNS = ["sentence", "dialog", "spoken"]

# Class names in label order.
NEWS_CATEGORIES = [
    "ENTERTAINMENT", "POLITICS", "WELLNESS", "TRAVEL", "STYLE & BEAUTY",
    "PARENTING", "HEALTHY LIVING", "QUEER VOICES", "FOOD & DRINK", "BUSINESS",
]
CLASS_LABELS = {
    "emotion": ["sadness", "joy", "love", "anger", "fear", "surprise"],
    "sentiment": ["negative", "positive"],
    "news": NEWS_CATEGORIES,
    "bbc_news": ["tech", "business", "sport", "entertainment", "politics"],
}

# Code point ranges with the Unicode property Emoji, plus the
# joiner, variation selector, keycap and tag characters used inside sequences.
EMOJI_RANGES = (
    "200D 20E3 FE0F E0020-E007F "
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 "
    "23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 "
    "261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 "
    "2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 "
    "26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA "
    "26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 "
    "2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF "
    "2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF "
    "1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F "
    "1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B "
    "1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 "
    "1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 "
    "1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF "
    "1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 "
    "1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 "
    "1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 "
    "1FAF0-1FAF8"
)
EMOJI_CLASS = "".join(
    "-".join(f"\\x{{{point}}}" for point in span.split("-")) for span in EMOJI_RANGES.split()
)

# Characters kept by cleaning, the URL pattern, the script counted
# by the script share. Escapes in the form both Java and RE2 read.
KEPT_CHARS = r" .,?!/@$%~％·∼()\x00-\x7Fㄱ-ㅎ가-힣"
URL_PATTERN = r"https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*)"
HANGUL_CLASS = "ㄱ-ㅎ가-힣"

# White space as Python's re and str.strip see it, spelled out because
# Java's Unicode mode is slow. The two ranges around it let most characters pass after two looks.
SPACE_CHARS = (r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE_CLASS = f"[[\\x00-\\x20\\x85-\\u3000]&&[{SPACE_CHARS}]]"
