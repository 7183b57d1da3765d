"""Values that other tools depend on and that therefore may not change.

Nothing here is logic: token strings and their ids, template literals, the
whitespace set and the vision constants are data that a trained model expects.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The 29 code points that Python's str.strip() and re's \s accept.
# ---------------------------------------------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class (valid for Java and for RE2).
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# ---------------------------------------------------------------------------
# Roles, slots and default texts of the sample format.
# ---------------------------------------------------------------------------
USER_SOURCES = ("human", "user")
ASSISTANT_SOURCES = ("gpt", "assistant")
IMAGE_SLOT = "<image>"
VIDEO_SLOT = "<video>"
STRICT_USER_TEXT = "Please describe this image."
DEFAULT_SYSTEM_TEXT = "You are a helpful assistant."

# ---------------------------------------------------------------------------
# Chat template literals.
# ---------------------------------------------------------------------------
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
PAD_TOKEN = "<|endoftext|>"
VISION_IMAGE = "<|vision_start|><|image_pad|><|vision_end|>"
VISION_VIDEO = "<|vision_start|><|video_pad|><|vision_end|>"
TOOLS_HEAD = (
    "# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_TAIL = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)

# ---------------------------------------------------------------------------
# Reserved token ids of the two chat formats, (id, token, special).
# ---------------------------------------------------------------------------
SPECIAL_TOKENS = {
    "image_first": (
        (151643, "<|endoftext|>", True),
        (151644, "<|im_start|>", True),
        (151645, "<|im_end|>", True),
        (151646, "<image>", True),
        (151647, "<video>", True),
    ),
    "interleaved": (
        (151643, "<|endoftext|>", True),
        (151644, "<|im_start|>", True),
        (151645, "<|im_end|>", True),
        (151646, "<|object_ref_start|>", True),
        (151647, "<|object_ref_end|>", True),
        (151648, "<|box_start|>", True),
        (151649, "<|box_end|>", True),
        (151650, "<|quad_start|>", True),
        (151651, "<|quad_end|>", True),
        (151652, "<|vision_start|>", True),
        (151653, "<|vision_end|>", True),
        (151654, "<|vision_pad|>", True),
        (151655, "<|image_pad|>", True),
        (151656, "<|video_pad|>", True),
        (151657, "<tool_call>", False),
        (151658, "</tool_call>", False),
        (151659, "<|fim_prefix|>", False),
        (151660, "<|fim_middle|>", False),
        (151661, "<|fim_suffix|>", False),
        (151662, "<|fim_pad|>", False),
        (151663, "<|repo_name|>", False),
        (151664, "<|file_sep|>", False),
        (151665, "<tool_response>", False),
        (151666, "</tool_response>", False),
        (151667, "<think>", False),
        (151668, "</think>", False),
    ),
}
PAD_ID = 151643
IMAGE_ID = 151646
FIRST_RESERVED_ID = 151643
IGNORE_LABEL = -100

# ---------------------------------------------------------------------------
# Vision settings.
# ---------------------------------------------------------------------------
GRID_EDGES = (384, 768, 1152, 1536, 1920, 2304)
TILE_EDGE = 384
TILE_PATCHES = 27
BASE_VISUAL_TOKENS = 729
DYNAMIC_EDGE = 32
DYNAMIC_MIN_AREA = 65536
DYNAMIC_MAX_AREA = 16777216

# ---------------------------------------------------------------------------
# Defaults of a training run.
# ---------------------------------------------------------------------------
DEFAULT_SEED = 42
DEFAULT_SHUFFLE_BUFFER = 10_000
DEFAULT_MAX_LENGTH = 1024
DEFAULT_STOP = "all_exhausted"
