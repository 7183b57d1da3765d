"""SQL counterparts of the registered queries, written for DuckDB.

They restate each result from the tables with grouping, windows and list
functions, and share no code with the DataFrame side but the fixed token ids.
"""

from __future__ import annotations

import re

from colloquy import fixed

WS = fixed.WHITESPACE_CLASS
SPECIAL = fixed.SPECIAL_TOKENS["image_first"]


def piece(special) -> str:
    return "|".join([re.escape(t) for _, t, _ in special] + [r"\p{L}+", r"\p{N}", WS + "+", r"[^\p{L}\p{N}" + WS[1:]])


def special_rows(special) -> str:
    return ", ".join(f"('{t}', {i}::BIGINT, {str(s).lower()})" for i, t, s in special)


PIECE, SPECIAL_ROWS = piece(SPECIAL), special_rows(SPECIAL)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean(x: str) -> str:
    return strip(f"regexp_replace({strip(f'coalesce({x}, chr(32))')}, '<image>{WS}*', '', 'g')")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


RAW = """raw AS (SELECT conv_id, turn,
  CASE WHEN role='user' THEN CASE WHEN conv_id%2=0 THEN 'human' ELSE 'user' END
       WHEN role='assistant' THEN CASE WHEN conv_id%2=0 THEN 'gpt' ELSE 'assistant' END
       ELSE role END AS src,
  CASE WHEN role='assistant' AND conv_id%11=3 THEN concat(' ',chr(10))
       WHEN role='user' AND conv_id%13=5 THEN NULL
       WHEN role='user' AND conv_id%3<>0 AND turn<=1 THEN concat('<image>',chr(10),text,' ')
       ELSE text END AS value,
  CASE WHEN conv_id%3<>0 THEN 64+(conv_id*97)%2400 END AS img_w,
  CASE WHEN conv_id%3<>0 THEN 64+(conv_id*61)%1800 END AS img_h,
  conv_id%3 AS source_id FROM conversations)"""
USER, REPLY = "src IN ('human','user')", "src IN ('gpt','assistant')"
CLEAN = f"""cleaned AS (SELECT *, {clean('value')} AS text,
  CASE WHEN {USER} THEN 'user' WHEN {REPLY} THEN 'assistant' END AS role,
  CASE WHEN src='system' THEN 'system' WHEN {USER} THEN 'user' WHEN {REPLY} THEN 'assistant' END AS full_role
  FROM raw)"""
CONV = """conv AS (SELECT conv_id, max(source_id) AS source_id, max(img_w) AS img_w, max(img_h) AS img_h,
  count(*) AS n_turns FROM raw GROUP BY conv_id)"""
FIRST = """first_user AS (SELECT conv_id, min(turn) AS at FROM cleaned WHERE role='user' GROUP BY conv_id)"""


def msg(role: str = "role") -> str:
    return f"""msg AS (SELECT c.conv_id, c.turn, c.{role} AS role, c.text, c.img_w,
      coalesce(c.img_w IS NOT NULL AND c.turn = f.at, false) AS slot,
      row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS i
      FROM cleaned c LEFT JOIN first_user f USING (conv_id)
      WHERE c.{role} IN ('user','system') OR (c.{role}='assistant' AND c.text<>''))"""


BASE = (RAW, CLEAN, CONV, FIRST, msg())
FULL = (RAW, CLEAN, CONV, FIRST, msg("full_role"))
CHAT = """'<|im_start|>'||role||' '||CASE WHEN slot THEN '<image>' ELSE '' END||chr(10)||text||'<|im_end|>'"""
# Accepted by the current rules: a reply with text, and a slot for the image if there is one.
PROMPT = f"""prompts AS (SELECT conv_id, string_agg({CHAT}, '' ORDER BY turn) AS prompt,
  count(*) FILTER (WHERE slot) AS n_slots FROM msg GROUP BY conv_id
  HAVING bool_or(role='assistant') AND (max(img_w) IS NULL OR bool_or(slot)))"""
PIECES = f"pieced AS (SELECT conv_id, regexp_extract_all(prompt, '{PIECE}') AS pieces FROM prompts)"


def vocab(pieces_of: str, size: int, special=SPECIAL) -> str:
    reserved = ", ".join(f"'{t}'" for _, t, _ in special)
    return f"""counted AS (SELECT piece, count(*) AS uses FROM (SELECT unnest(pieces) AS piece FROM {pieces_of})
      WHERE piece NOT IN ({reserved}) GROUP BY piece),
    vocab AS (SELECT piece, uses, row_number() OVER (ORDER BY uses DESC, piece) - 1 AS token_id, false AS special
      FROM counted QUALIFY token_id < {size}
      UNION ALL SELECT piece, NULL, token_id, special FROM (VALUES {special_rows(special)}) s(piece, token_id, special))"""


def ids_of(pieces_of: str, key: str = "conv_id") -> str:
    """Ids of all pieces; a piece without an id becomes one id per byte."""
    utf8 = "list_transform(range(octet_length(encode(n.piece))), lambda k: 151387 + ('0x'||substr(hex(encode(n.piece)), 2*k+1, 2))::BIGINT)"
    return f"""numbered AS (SELECT {key}, unnest(pieces) AS piece, unnest(range(len(pieces))) AS at FROM {pieces_of}),
      ids AS (SELECT n.{key}, flatten(list(CASE WHEN v.token_id IS NULL THEN {utf8} ELSE [v.token_id] END ORDER BY n.at)) AS ids
        FROM numbered n LEFT JOIN vocab v USING (piece) GROUP BY n.{key})"""


WORDS, FEW_WORDS = 151_387, 2_000
TOKENS = (*BASE, PROMPT, PIECES, vocab("pieced", WORDS), ids_of("pieced"))
FEW_TOKENS = (*BASE, PROMPT, PIECES, vocab("pieced", FEW_WORDS), ids_of("pieced"))

GRID = """grid AS (SELECT row_number() OVER (ORDER BY h, w) AS i, h, w FROM
  (SELECT unnest([384,768,1152,1536,1920,2304]) AS h), (SELECT unnest([384,768,1152,1536,1920,2304]) AS w))"""
CELL = """rated AS (SELECT conv_id, c.source_id, c.img_w, c.img_h, g.h, g.w, g.i, least(
    floor(img_w*least(g.w/img_w, g.h/img_h))*floor(img_h*least(g.w/img_w, g.h/img_h)), img_w*img_h) AS usable
  FROM conv c, grid g WHERE img_w IS NOT NULL),
  cell AS (SELECT * FROM rated QUALIFY row_number() OVER
    (PARTITION BY conv_id ORDER BY usable DESC, h*w-usable, i) = 1),
  patch AS (SELECT *, 27*(h//384) AS ch, 27*(w//384) AS cw FROM cell),
  fitted AS (SELECT *, CASE WHEN img_w/img_h > cw/ch THEN ch-2*((ch-(img_h*cw)//img_w)//2) ELSE ch END AS gh,
    CASE WHEN img_w/img_h > cw/ch THEN cw ELSE cw-2*((cw-(img_w*ch)//img_h)//2) END AS gw FROM patch)"""


def anyres(tiles: int) -> str:
    r = f"sqrt(gh*gw/{tiles * 729})"
    rows = f"CASE WHEN {r}>1.1 THEN floor(gh/{r}) ELSE gh END"
    cols = f"CASE WHEN {r}>1.1 THEN floor(gw/{r}) ELSE gw END"
    return f"(729+({rows})*({cols})+({rows}))::BIGINT"


BUDGET = f"budget AS (SELECT conv_id, {anyres(1)} AS n_visual FROM fitted)"


def expanded_by(image_id: int) -> str:
    return f"""expanded AS (SELECT conv_id, source_id, flatten(list_transform(ids, lambda x: CASE WHEN x={image_id}
  THEN list_resize([x], coalesce(n_visual, 1), x) ELSE [x] END)) AS ids
  FROM ids JOIN conv USING (conv_id) LEFT JOIN budget USING (conv_id))"""


EXPANDED = expanded_by(151646)
VISION = (GRID, CELL, BUDGET)


def gapped(conv_columns: str = "") -> str:
    """Conversations with the missing, empty and one-sided ones."""
    return f"""gap_turns AS (SELECT * FROM cleaned WHERE conv_id%17 NOT IN (1,2)
        AND NOT (conv_id%17=3 AND {USER}) AND NOT (conv_id%17=4 AND {REPLY})),
      gap AS (SELECT c.conv_id, c.source_id, c.img_w, c.conv_id%17=1 AS absent,
        count(t.turn) AS n, coalesce(bool_or(t.role='user'), false) AS has_user, count(*) FILTER (WHERE t.role='user') AS users,
        coalesce(bool_or(t.role='assistant' AND t.text<>''), false) AS has_reply,
        coalesce(bool_or(t.conv_id IS NOT NULL AND (t.src IS NULL OR t.value IS NULL)), false) AS has_null,
        coalesce(bool_or(t.value IS NULL AND t.role IS DISTINCT FROM 'user'), false) AS null_unasked
        FROM conv c LEFT JOIN gap_turns t USING (conv_id) GROUP BY ALL),
      reason AS (SELECT conv_id, source_id,
        CASE WHEN absent THEN 'null_conversation' WHEN n=0 THEN 'no_turns' WHEN NOT has_reply THEN 'no_assistant_text'
          WHEN img_w IS NOT NULL AND NOT has_user THEN 'image_without_slot'
          WHEN conv_id%17=5 AND has_user THEN 'misaligned' END AS current,
        CASE WHEN absent THEN 'null_conversation' WHEN n=0 THEN 'no_turns' WHEN img_w IS NULL THEN 'no_image'
          WHEN NOT has_user THEN 'no_user_turn' WHEN NOT has_reply THEN 'no_assistant_text'
          WHEN conv_id%17=5 THEN 'misaligned' END AS strict,
        CASE WHEN absent THEN 'null_conversation' WHEN img_w IS NULL THEN 'no_image'
          WHEN CASE WHEN conv_id%17=5 THEN null_unasked ELSE has_null END THEN 'null_turn' END AS legacy FROM gap)"""


GAPS = (RAW, CLEAN, CONV, gapped())


def order_key(*parts: str) -> str:
    return "md5(concat_ws('|', '42', " + ", ".join(parts) + "))"


def draw(slot: str, steps: list[tuple[str, float | None]]) -> str:
    u = f"('0x'||substr(md5('42|'||{slot}),1,8))::BIGINT / 4294967296.0"
    cases = " ".join(f"WHEN {u} < {limit} THEN {k}" for k, limit in steps[:-1])
    return f"CASE {cases} ELSE {steps[-1][0]} END"


SHUFFLED = (
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {order_key('source_id', 'id')}, id) - 1 AS rank FROM keys)",
)
# The buffer restated: a row leaves with the next draw of its place, the others follow by hash.
BUFFERED = (
    """arrived AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) - 1 AS nth, count(*) OVER (PARTITION BY source_id) AS n,
      CASE source_id WHEN 'de' THEN 16 WHEN 'en' THEN 100 WHEN 'es' THEN 7 ELSE 10000 END AS b FROM keys)""",
    f"""stood AS (SELECT *, CASE WHEN nth < b THEN nth ELSE ('0x'||substr({order_key('source_id', 'nth')}, 1, 8))::BIGINT % b END AS place FROM arrived)""",
    "gone AS (SELECT *, lead(nth) OVER (PARTITION BY source_id, place ORDER BY nth) - b AS early FROM stood)",
    f"""ranked AS (SELECT id, source_id, coalesce(early, greatest(n - b, 0) + row_number() OVER (PARTITION BY source_id, early IS NULL
      ORDER BY {order_key('source_id', 'id')}, id) - 1) AS rank FROM gone)""",
)


def mixed(keys: str, steps: list, stop: str, slots: int, ranked: tuple[str, ...] = SHUFFLED) -> tuple[str, ...]:
    """Interleaving restated: number the draws per source, stop where the rule says, wrap around."""
    extreme = "max" if stop == "all_exhausted" else "min"
    return (
        keys,
        *ranked,
        "lens AS (SELECT source_id, count(*) AS len FROM keys GROUP BY source_id)",
        f"drawn AS (SELECT slot, {draw('slot', steps)} AS source_id FROM (SELECT unnest(range({slots})) AS slot))",
        "turns AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY slot) AS k FROM drawn)",
        f"stop AS (SELECT {extreme}(slot) AS last FROM turns JOIN lens USING (source_id) WHERE k = len)",
        """mixed AS (SELECT t.source_id, t.slot AS pos, (k-1)//len AS pass, r.id FROM turns t JOIN lens l USING (source_id)
          JOIN ranked r ON r.source_id=t.source_id AND r.rank=(k-1)%len WHERE t.slot <= (SELECT last FROM stop))""",
    )


# The image files, as far as their headers and damages follow from the conversation.
FILES = """files AS (SELECT conv_id, img_w, img_h, 'part='||conv_id%7||'/conv-'||conv_id AS ref,
  ['png', 'gif', 'jpeg', 'bmp', 'webp', 'tiff'][conv_id//5%6+1] AS kind FROM conv WHERE img_w IS NOT NULL)"""
DOC_KEYS = "keys AS (SELECT doc_id AS id, lang AS source_id FROM documents)"
DOC_STEPS = [("'de'", 0.25), ("'en'", 0.375), ("'es'", 0.75), ("'fr'", None)]
CONV_KEYS = "keys AS (SELECT DISTINCT conv_id AS id, (conv_id%3)::INTEGER AS source_id FROM conversations)"
CONV_STEPS = [("0", 0.25), ("1", 0.75), ("2", None)]
# More slots than the rule ever needs on the given tables.
DOC_SLOTS = "(SELECT 12*count(*)+4000 FROM documents)"
CONV_SLOTS = "(SELECT 12*count(DISTINCT conv_id)+1000 FROM conversations)"
DOC_MIX = mixed(DOC_KEYS, DOC_STEPS, "all_exhausted", DOC_SLOTS)
CONV_MIX = mixed(CONV_KEYS, CONV_STEPS, "all_exhausted", CONV_SLOTS)
PLANNED = (*GAPS, *CONV_MIX, "planned AS (SELECT pos, m.id, r.current IS NULL AS valid FROM mixed m JOIN reason r ON r.conv_id=m.id)")


def padded(batch: int, cut: int) -> tuple[str, ...]:
    return (
        *TOKENS, *VISION, EXPANDED,
        f"placed AS (SELECT conv_id, row_number() OVER (ORDER BY {order_key('0', 'conv_id')}, conv_id) - 1 AS pos, ids[1:{cut}] AS ids FROM expanded)",
        f"batched AS (SELECT *, pos//{batch} AS batch_id, len(ids) AS length FROM placed)",
        "wide AS (SELECT *, max(length) OVER (PARTITION BY batch_id) AS width FROM batched)",
        """filled AS (SELECT conv_id, pos, batch_id, length, width,
          ids || list_resize([]::BIGINT[], width-length, 151643) AS input_ids,
          list_resize([]::BIGINT[], length, 1) || list_resize([]::BIGINT[], width-length, 0) AS mask,
          ids || list_resize([]::BIGINT[], width-length, -100) AS labels FROM wide)""",
    )


def text(x: str) -> str:
    return f"array_to_string({x}, ',')"


def count_of(token: str, where: str = "prompt") -> str:
    return f"((length({where})-length(replace({where}, '{token}', '')))//{len(token)})"


DOC_SAMPLE = f"""doc AS (SELECT doc_id, lang, n_chars,
   CASE WHEN doc_id%7<>0 THEN {clean("'<image> Describe item '||doc_id")} ELSE '' END AS asked,
   CASE WHEN doc_id%5<>0 THEN {clean('text')} ELSE '' END AS told, doc_id%3<>0 AS has_image FROM documents)"""
DOC_PROMPT = f"""doc_prompts AS (SELECT doc_id, lang, has_image, '<|im_start|>user '||CASE WHEN has_image THEN '<image>' ELSE '' END||chr(10)||asked
   ||'<|im_end|><|im_start|>assistant '||chr(10)||told||'<|im_end|>' AS prompt FROM doc WHERE told<>'')"""
DOC_CONV = """conv AS (SELECT doc_id AS conv_id, lang AS source_id, CASE WHEN doc_id%3<>0 THEN 64+(doc_id*97)%2400 END AS img_w,
   CASE WHEN doc_id%3<>0 THEN 64+(doc_id*61)%1800 END AS img_h FROM documents)"""
DOC_PIECES = f"doc_pieced AS (SELECT doc_id, lang, prompt, regexp_extract_all(prompt, '{PIECE}') AS pieces FROM doc_prompts)"
# Placeholders and pieces of a document's prompt, and its length after expansion.
DOC_STREAM = (
    DOC_SAMPLE, DOC_PROMPT, DOC_CONV, *VISION, DOC_PIECES,
    f"""doc_ready AS (SELECT doc_id, lang, prompt, {count_of('<image>')} AS n_slots, len(pieces) AS n_pieces,
      len(pieces) + {count_of('<image>')}*(coalesce(n_visual, 1)-1) AS n_tokens, n_visual, pieces
      FROM doc_pieced LEFT JOIN budget ON conv_id=doc_id)""",
)

IMAGE_PART = "CASE WHEN slot THEN 'image;' ELSE '' END"


def messages(fallback: str) -> str:
    body = f"CASE WHEN role='user' AND text='' THEN '{fallback}' ELSE text END"
    return (
        with_(*BASE)
        + f"""SELECT c.conv_id, count(m.turn) AS n_messages,
        coalesce(string_agg(role||'['||{IMAGE_PART}||'text='||{body}||']', '|' ORDER BY turn), '') AS messages
        FROM conv c LEFT JOIN msg m USING (conv_id) GROUP BY c.conv_id"""
    )


def prompt_of(chat: str, ctes=BASE) -> str:
    return with_(*ctes) + f"""SELECT c.conv_id, coalesce(string_agg({chat}, '' ORDER BY turn), '') AS prompt
        FROM conv c LEFT JOIN msg m USING (conv_id) GROUP BY c.conv_id"""


BLOCK = "'<|im_start|>'||role||chr(10)||text||'<|im_end|>'||chr(10)"
SHOW = "'<|vision_start|><|image_pad|><|vision_end|>'"
PLAY = "'<|vision_start|><|video_pad|><|vision_end|>'"
MEDIA = f"""media AS (SELECT *, (role='user' AND i%3=0) AS pic, (role='user' AND i%4=0) AS vid,
    sum((slot)::INT + (role='user' AND i%3=0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS pics,
    sum((role='user' AND i%4=0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS vids FROM msg)"""


def interleaved(numbered: bool) -> str:
    def label(name: str, number: str) -> str:
        return f"'{name} '||({number})::BIGINT||': '||" if numbered else ""

    return f"""CASE WHEN role='system' AND i>0 THEN '' ELSE '<|im_start|>'||role||chr(10)
      ||CASE WHEN slot THEN {label('Picture', 'pics-pic::INT')}{SHOW} ELSE '' END||text
      ||CASE WHEN pic THEN {label('Picture', 'pics')}{SHOW} ELSE '' END
      ||CASE WHEN vid THEN {label('Video', 'vids')}{PLAY} ELSE '' END||'<|im_end|>'||chr(10) END"""


TOOL_HEAD = fixed.TOOLS_HEAD.replace("'", "''")
TOOL_TAIL = fixed.TOOLS_TAIL.replace("'", "''")
TOOLED = """tooled AS (SELECT *, CASE WHEN role='user' AND i%4>=2 THEN 'tool' ELSE role END AS part,
    (role='assistant' AND i%4=1) AS mute, (role='assistant' AND i%4<=1) AS calls FROM msg),
  around AS (SELECT *, lag(part) OVER w AS before, lead(part) OVER w AS after FROM tooled
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
CALLS = """CASE WHEN calls THEN CASE WHEN mute THEN '' ELSE chr(10) END
   ||'<tool_call>'||chr(10)||'{"name": "measure", "arguments": {"size": '||length(text)||'}}'||chr(10)||'</tool_call>'||chr(10)
   ||'<tool_call>'||chr(10)||'{"name": "store", "arguments": {"size": '||length(text)||'}}'||chr(10)||'</tool_call>' ELSE '' END"""
TOOL_MESSAGE = f"""CASE part
  WHEN 'user' THEN '<|im_start|>user'||chr(10)||CASE WHEN slot THEN {SHOW} ELSE '' END||text||'<|im_end|>'||chr(10)
  WHEN 'assistant' THEN '<|im_start|>assistant'||chr(10)||CASE WHEN mute THEN '' ELSE text END||{CALLS}||'<|im_end|>'||chr(10)
  WHEN 'tool' THEN CASE WHEN before='tool' THEN '' ELSE '<|im_start|>user' END||chr(10)||'<tool_response>'||chr(10)
    ||CASE WHEN slot THEN {SHOW} ELSE '' END||text||chr(10)||'</tool_response>'||CASE WHEN after='tool' THEN '' ELSE '<|im_end|>'||chr(10) END
  ELSE '' END"""

HEADER_KIND = "CASE conv_id%10 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' WHEN 5 THEN 'bmp' WHEN 6 THEN 'webp' WHEN 7 THEN 'tiff' WHEN 8 THEN 'webp' WHEN 9 THEN 'png' END"
SIZED = "conv_id%10 IN (0,1,2,5,6,7,8)"
METRIC = """metric AS (SELECT user_id%5 AS run, event_id%3 AS epoch, event_id AS step, 1+event_id%4 AS batch_size,
  value AS loss FROM events)"""

PROMPT_STRICT = f"""prompts AS (SELECT conv_id, string_agg('<|im_start|>'||role||' '||CASE WHEN slot THEN '<image>' ELSE '' END||chr(10)
  ||CASE WHEN role='user' AND text='' THEN '{fixed.STRICT_USER_TEXT}' ELSE text END||'<|im_end|>', '' ORDER BY turn) AS prompt,
  count(*) FILTER (WHERE slot) AS n_slots FROM msg GROUP BY conv_id HAVING bool_or(role='assistant') AND bool_or(slot))"""
PROMPT_LEGACY = f"""prompts AS (SELECT conv_id,
  string_agg(CASE WHEN {USER} THEN 'USER' ELSE 'ASSISTANT' END||': '||{strip('value')}, chr(10) ORDER BY turn) AS prompt
  FROM raw GROUP BY conv_id HAVING max(img_w) IS NOT NULL AND NOT bool_or(src IS NULL OR value IS NULL))"""
PROMPT_INTERLEAVED = f"""prompts AS (SELECT conv_id, string_agg('<|im_start|>'||role||chr(10)||CASE WHEN slot THEN {SHOW} ELSE '' END||text
  ||'<|im_end|>'||chr(10), '' ORDER BY turn) AS prompt FROM msg GROUP BY conv_id
  HAVING bool_or(role='assistant') AND (max(img_w) IS NULL OR bool_or(slot)))"""
SIDES = """sides AS (SELECT conv_id, img_w::DOUBLE AS w, img_h::DOUBLE AS h, greatest(32, round_even(img_w/32.0::DOUBLE, 0)*32) AS rw, greatest(32, round_even(img_h/32.0::DOUBLE, 0)*32) AS rh FROM conv WHERE img_w IS NOT NULL)"""
DYNAMIC = SIDES + """, budget AS (SELECT conv_id, CASE WHEN rw*rh>16777216 THEN greatest(32, floor(w/sqrt(h*w/16777216)/32)*32)*greatest(32, floor(h/sqrt(h*w/16777216)/32)*32)
  WHEN rw*rh<65536 THEN ceil(w*sqrt(65536/(h*w))/32)*32*ceil(h*sqrt(65536/(h*w))/32)*32 ELSE rw*rh END::BIGINT//1024 AS n_visual FROM sides)"""


def training(prompt: str, keys_of: str, special=SPECIAL, image_id: int = 151646, vision=VISION, steps=None) -> str:
    """All conversations of ``keys_of`` are mixed and batched, those with a prompt are encoded and padded."""
    steps = steps or CONV_STEPS
    return with_(
        *BASE, prompt,
        f"pieced AS (SELECT conv_id, regexp_extract_all(prompt, '{piece(special)}') AS pieces FROM prompts)",
        vocab("pieced", WORDS, special), ids_of("pieced"), *vision, expanded_by(image_id),
        *mixed(f"keys AS (SELECT conv_id AS id, (conv_id%3)::INTEGER AS source_id FROM {keys_of})", steps, "all_exhausted", CONV_SLOTS),
        "cut AS (SELECT pos, id, pass, pos//4 AS batch_id, ids[1:2048] AS ids, CASE WHEN id%3<>0 THEN 'img-'||id%50 END AS ref FROM mixed JOIN expanded ON conv_id=id)",
        "wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM cut)",
    ) + f"SELECT pos, id, pass, batch_id, ref, width, len(ids) AS length, md5({text('ids || list_resize([]::BIGINT[], width-len(ids), -100)')}) AS labels_md5 FROM wide"


ORACLES: dict[str, str] = {
    "source_split": "SELECT doc_id, n_chars, 3::BIGINT AS source_id, 2.0::DOUBLE AS weight FROM documents WHERE lang='en'",
    "source_mixture": "SELECT doc_id, lang AS source_id, CASE lang WHEN 'en' THEN 1.0 WHEN 'es' THEN 3.0 ELSE 2.0 END::DOUBLE AS weight, n_chars FROM documents WHERE lang IN ('de','en','es','fr')",
    "source_stream": "SELECT doc_id, n_chars, 1::BIGINT AS source_id FROM documents WHERE lang='de'",
    "nested_samples": with_(RAW) + "SELECT conv_id, count(*) AS n_turns, string_agg(src||':'||coalesce(length(value),-1), '|' ORDER BY turn) AS turns FROM raw GROUP BY conv_id",
    "exploded_turns": with_(RAW) + "SELECT conv_id, source_id, turn, src, value FROM raw",
    "training_shards": with_(*DOC_MIX) + "SELECT pos//500 AS shard, count(*) AS rows, min(pos) AS first_pos, max(pos) AS last_pos, sum(id)::BIGINT AS id_sum FROM mixed GROUP BY 1",
    "image_payload": with_(RAW, CONV) + "SELECT conv_id, CASE WHEN img_w IS NOT NULL THEN 'img-'||conv_id%50 END AS ref, CASE WHEN img_w IS NOT NULL THEN md5('img-'||conv_id%50) END AS payload FROM conv",
    "image_fetch": with_(RAW, CONV, FILES) + """, shared AS (SELECT * FROM files WHERE conv_id%6=4 ORDER BY ref LIMIT 1)
        SELECT conv_id, kind AS format, img_w AS width, img_h AS height FROM files WHERE conv_id%6=2
        UNION ALL SELECT f.conv_id, s.kind, s.img_w, s.img_h FROM files f, shared s WHERE f.conv_id%6=4""",
    "image_ranged_headers": with_(RAW, CONV, FILES) + "SELECT conv_id, kind AS format, img_w AS width, img_h AS height, true AS few_bytes FROM files",
    "image_integrity": with_(RAW, CONV, FILES) + "SELECT conv_id, kind, NOT (conv_id%5=1 AND kind<>'tiff' OR conv_id%5=2 AND kind='png') AS whole FROM files",
    "file_shards": """WITH parted AS (SELECT doc_id, floor(sqrt(doc_id%289))::INTEGER AS part FROM documents),
        files AS (SELECT part, count(*) AS n FROM parted GROUP BY part),
        placed AS (SELECT part, row_number() OVER (ORDER BY n DESC, 'part='||part||'/') - 1 AS nth FROM files),
        dealt AS (SELECT part, CASE WHEN nth//3%2=0 THEN nth%3 ELSE 2-nth%3 END AS rank, CASE WHEN nth//3//2%2=0 THEN nth//3%2 ELSE 1-nth//3%2 END AS worker FROM placed)
        SELECT rank, worker, count(DISTINCT part) AS files, count(*) AS rows, sum(doc_id)::BIGINT AS id_sum FROM parted JOIN dealt USING (part) GROUP BY 1, 2""",
    "sample_flags": with_(*GAPS) + "SELECT conv_id, n>0 AS has_turns, img_w IS NOT NULL AS has_image FROM gap",
    "valid_legacy": with_(*GAPS) + "SELECT conv_id FROM gap WHERE NOT absent AND img_w IS NOT NULL",
    "valid_strict": with_(*GAPS) + "SELECT conv_id FROM gap WHERE img_w IS NOT NULL AND has_user AND has_reply",
    "valid_current": with_(*GAPS) + "SELECT conv_id FROM gap WHERE has_reply",
    "kept_turns": with_(RAW, CLEAN, CONV) + "SELECT c.conv_id, coalesce(string_agg(concat_ws(':', src, length(value)), '|' ORDER BY turn) FILTER (WHERE role='user' OR (role='assistant' AND text<>'')), '') AS turns FROM conv c JOIN cleaned USING (conv_id) GROUP BY c.conv_id",
    "image_headers": with_(RAW, CONV) + f"SELECT conv_id, {HEADER_KIND} AS format, CASE WHEN {SIZED} THEN img_w END AS width, CASE WHEN {SIZED} OR conv_id%10=9 THEN img_h END AS height FROM conv WHERE img_w IS NOT NULL",
    "image_probe": with_(RAW, CONV) + f"SELECT conv_id, {SIZED} AS decodable FROM conv WHERE img_w IS NOT NULL",
    **{f"quarantine_{v}": with_(*GAPS) + f"SELECT conv_id, {v} AS reject_reason FROM reason" for v in ("current", "strict", "legacy")},
    "quarantine_tables": with_(*GAPS) + "SELECT strict IS NULL AS accepted, count(*) AS rows, sum(conv_id)::BIGINT AS id_sum FROM reason GROUP BY 1",
    "reject_counts": with_(*GAPS) + "SELECT source_id, current AS reject_reason, count(*) AS rejects FROM reason WHERE current IS NOT NULL GROUP BY 1, 2",
    "reject_totals": with_(*GAPS) + "SELECT source_id, strict AS reject_reason, count(*) AS rejects FROM reason WHERE strict IS NOT NULL GROUP BY ROLLUP (source_id, strict)",
    "filtered_samples": with_(RAW, CONV) + "SELECT conv_id FROM conv WHERE n_turns>=6",
    "filtered_samples_python": with_(RAW, CONV) + "SELECT conv_id FROM conv WHERE img_w>1 AND len(list_filter(range(2, img_w), lambda d: img_w%d=0))=0",
    "cleaned_text": with_(RAW, CLEAN) + f"SELECT conv_id, turn, text, {strip('value')} AS stripped FROM cleaned",
    "turn_roles": with_(RAW, CLEAN) + f"SELECT conv_id, turn, role, full_role AS role_with_system, CASE WHEN {USER} THEN 'USER' ELSE 'ASSISTANT' END AS speaker FROM cleaned",
    "user_fallback": with_(RAW, CLEAN) + f"SELECT conv_id, turn, text, CASE WHEN text='' THEN '{fixed.STRICT_USER_TEXT}' ELSE text END AS strict_text FROM cleaned WHERE role='user'",
    "messages_current": messages(""),
    "messages_strict": messages(fixed.STRICT_USER_TEXT),
    "image_slots": with_(RAW, CLEAN, CONV, FIRST) + "SELECT c.conv_id, CASE WHEN img_w IS NOT NULL THEN f.at END AS slot_turn FROM conv c LEFT JOIN first_user f USING (conv_id)",
    "transcripts": with_(RAW, CONV) + f"SELECT conv_id, CASE WHEN bool_or(src IS NULL OR value IS NULL) THEN NULL ELSE string_agg(CASE WHEN {USER} THEN 'USER' ELSE 'ASSISTANT' END||': '||{strip('value')}, chr(10) ORDER BY turn) END AS transcript FROM raw GROUP BY conv_id",
    "prompts_image_first": with_(*BASE, PROMPT) + "SELECT conv_id, prompt, n_slots FROM prompts",
    "prompts_strict": with_(*BASE) + f"""SELECT conv_id, string_agg('<|im_start|>'||role||' '||CASE WHEN slot THEN '<image>' ELSE '' END||chr(10)
        ||CASE WHEN role='user' AND text='' THEN '{fixed.STRICT_USER_TEXT}' ELSE text END||'<|im_end|>', '' ORDER BY turn) AS prompt,
        count(*) FILTER (WHERE slot) AS n_slots FROM msg GROUP BY conv_id
        HAVING bool_or(role='assistant') AND bool_or(slot)""",
    "prompts_text": with_(*FULL) + f"""SELECT c.conv_id, coalesce(CASE WHEN max(role) FILTER (WHERE i=0)<>'system' THEN
        '<|im_start|>system'||chr(10)||'{fixed.DEFAULT_SYSTEM_TEXT}'||'<|im_end|>'||chr(10) ELSE '' END||string_agg({BLOCK}, '' ORDER BY turn), '') AS prompt
        FROM conv c LEFT JOIN msg m USING (conv_id) GROUP BY c.conv_id""",
    "prompts_interleaved": with_(*FULL, MEDIA) + f"""SELECT c.conv_id, coalesce(string_agg({interleaved(False)}, '' ORDER BY turn), '') AS prompt,
        coalesce(string_agg({interleaved(True)}, '' ORDER BY turn), '')||'<|im_start|>assistant'||chr(10) AS numbered
        FROM conv c LEFT JOIN media m USING (conv_id) GROUP BY c.conv_id""",
    "prompts_tools": with_(*FULL, TOOLED) + f"""SELECT c.conv_id,
        CASE WHEN c.conv_id%2=0 THEN '<|im_start|>system'||chr(10)||coalesce(max(text||chr(10)||chr(10)) FILTER (WHERE i=0 AND role='system'), '')||'{TOOL_HEAD}'
          ||chr(10)||'{{"type": "function", "name": "tool, '||max(c.source_id)||': x"}}'||chr(10)||'{{"a": [1, 2]}}'||'{TOOL_TAIL}<|im_end|>'||chr(10)
        ELSE coalesce(max('<|im_start|>system'||chr(10)||text||'<|im_end|>'||chr(10)) FILTER (WHERE i=0 AND role='system'), '') END
        ||coalesce(string_agg({TOOL_MESSAGE}, '' ORDER BY turn), '') AS prompt
        FROM conv c LEFT JOIN around USING (conv_id) GROUP BY c.conv_id""",
    "prompts_generation": with_(*BASE) + f"SELECT c.conv_id, coalesce(string_agg({CHAT}, '' ORDER BY turn), '')||'<|im_start|>assistant'||chr(10) AS prompt FROM conv c LEFT JOIN msg m USING (conv_id) GROUP BY c.conv_id",
    "placeholder_counts": with_(*BASE) + "SELECT c.conv_id, count(*) FILTER (WHERE slot) AS n_slots FROM conv c LEFT JOIN msg m USING (conv_id) GROUP BY c.conv_id",
    "image_alignment": with_(*GAPS) + """, counted AS (SELECT conv_id, (has_user AND img_w IS NOT NULL)::BIGINT + CASE WHEN conv_id%17=5 THEN users ELSE 0 END AS n_slots, (img_w IS NOT NULL)::BIGINT AS n_images FROM gap)
        SELECT *, n_slots=n_images AS aligned FROM counted""",
    "assistant_spans": with_(*BASE) + "SELECT c.conv_id, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE role='assistant'), '') AS spoken FROM conv c LEFT JOIN msg m USING (conv_id) GROUP BY c.conv_id",
    "prompt_pieces": with_(*BASE, PROMPT, PIECES) + "SELECT conv_id, len(pieces) AS n_pieces, md5(array_to_string(pieces, chr(31))) AS pieces_md5 FROM pieced",
    "document_pieces": f"SELECT doc_id, len(p) AS n_pieces, md5(array_to_string(p, chr(31))) AS pieces_md5 FROM (SELECT doc_id, regexp_extract_all(text, '{PIECE}') AS p FROM documents)",
    "vocabulary": with_(*BASE, PROMPT, PIECES, vocab("pieced", WORDS)) + "SELECT piece, uses, token_id, special FROM vocab",
    "document_vocabulary": with_(f"pieced AS (SELECT regexp_extract_all(text, '{PIECE}') AS pieces FROM documents)", vocab("pieced", 20000)) + "SELECT piece, uses, token_id FROM vocab",
    "special_token_uses": with_(*BASE, PROMPT, PIECES, "used AS (SELECT piece, count(*) AS uses FROM (SELECT unnest(pieces) AS piece FROM pieced) GROUP BY piece)") + f"SELECT piece, token_id, special, coalesce(uses, 0) AS uses FROM (VALUES {SPECIAL_ROWS}) s(piece, token_id, special) LEFT JOIN used USING (piece)",
    "encoded_ids": with_(*TOKENS) + f"SELECT conv_id, {text('ids')} AS input_ids FROM ids",
    "encoded_ids_by_row": with_(*FEW_TOKENS) + f"SELECT conv_id, {text('ids')} AS input_ids FROM ids",
    "expanded_image_tokens": with_(*TOKENS, *VISION, EXPANDED) + f"SELECT conv_id, len(ids) AS n_input_ids, md5({text('ids')}) AS ids_md5, len(list_filter(ids, lambda x: x=151646)) AS n_image_tokens FROM expanded",
    "truncated_ids": with_(*TOKENS) + f"SELECT conv_id, {text('ids[1:1024]')} AS input_ids FROM ids",
    "truncation_losses": with_(*TOKENS, *VISION, EXPANDED) + """SELECT source_id, count(*) AS rows, count(*) FILTER (WHERE len(ids)>1024) AS rows_cut,
        sum(greatest(len(ids)-1024, 0))::BIGINT AS tokens_cut, count(*) FILTER (WHERE list_contains(ids[1025:], 151646)) AS rows_image_cut FROM expanded GROUP BY source_id""",
    "padded_batches": with_(*padded(4, 2048)) + f"SELECT conv_id, batch_id, length, width, md5({text('input_ids')}) AS ids_md5, md5({text('mask')}) AS mask_md5, md5({text('labels')}) AS labels_md5 FROM filled",
    "batch_summaries": with_(*padded(4, 2048)) + "SELECT batch_id, count(*) AS rows, max(width) AS width, sum(length)::BIGINT AS real_tokens, sum(len(list_filter(labels, lambda x: x<>-100)))::BIGINT AS supervised, round(1-sum(length)/(count(*)*max(width)), 6) AS pad_share FROM filled GROUP BY batch_id",
    "batch_modalities": with_(*padded(4, 2048)) + "SELECT batch_id, CASE WHEN NOT bool_or(img_w IS NOT NULL) THEN 'text' WHEN bool_and(img_w IS NOT NULL) THEN 'image' ELSE 'mixed' END AS modality, count(img_w) AS images FROM filled JOIN conv USING (conv_id) GROUP BY batch_id",
    "batch_image_refs": with_(*padded(4, 2048)) + "SELECT batch_id, coalesce(string_agg('img-'||conv_id%50, ',' ORDER BY pos) FILTER (WHERE img_w IS NOT NULL), '') AS images FROM filled JOIN conv USING (conv_id) GROUP BY batch_id",
    "collated_batches": with_(*padded(4, 2048)) + "SELECT batch_id, count(*) OVER (PARTITION BY batch_id) AS rows, conv_id AS longest_conv FROM filled QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY length DESC, conv_id)=1",
    "collated_rows": with_(*padded(4, 2048)) + "SELECT batch_id, count(*) OVER (PARTITION BY batch_id) AS rows, conv_id AS longest_conv FROM filled QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY length DESC, conv_id)=1",
    "plugged_tokenizer": with_(*BASE, PROMPT) + ", bytes AS (SELECT conv_id, hex(encode(prompt)) AS h FROM prompts) SELECT conv_id, length(h)//2 AS n_input_ids, list_sum(list_transform(range(length(h)//2), lambda k: ('0x'||substr(h, 2*k+1, 2))::BIGINT))::BIGINT AS id_sum FROM bytes",
    "vision_grid": with_(RAW, CONV, GRID, CELL) + "SELECT conv_id, h::BIGINT AS grid_h, w::BIGINT AS grid_w FROM cell",
    "vision_anyres": with_(RAW, CONV, GRID, CELL) + f"SELECT conv_id, {anyres(1)} AS tokens_1, {anyres(9)} AS tokens_9 FROM fitted",
    "vision_dynamic": with_(RAW, CONV) + """, sides AS (SELECT conv_id, img_w::DOUBLE AS w, img_h::DOUBLE AS h, greatest(32, round_even(img_w/32.0::DOUBLE, 0)*32) AS rw, greatest(32, round_even(img_h/32.0::DOUBLE, 0)*32) AS rh FROM conv WHERE img_w IS NOT NULL)
        SELECT conv_id, CASE WHEN rw*rh>16777216 THEN greatest(32, floor(w/sqrt(h*w/16777216)/32)*32)*greatest(32, floor(h/sqrt(h*w/16777216)/32)*32)
          WHEN rw*rh<65536 THEN ceil(w*sqrt(65536/(h*w))/32)*32*ceil(h*sqrt(65536/(h*w))/32)*32 ELSE rw*rh END::BIGINT//1024 AS tokens FROM sides""",
    "length_budget": with_(*BASE, PROMPT, PIECES, *VISION) + """, sized AS (SELECT c.source_id, len(pieces)-n_slots AS words, CASE WHEN n_slots>0 THEN n_slots*n_visual ELSE 0 END AS visual FROM pieced JOIN prompts USING (conv_id) JOIN conv c USING (conv_id) LEFT JOIN budget USING (conv_id))
        SELECT source_id, count(*) AS rows, sum(words)::BIGINT AS text_tokens, sum(visual)::BIGINT AS visual_tokens, count(*) FILTER (WHERE words+visual>2048) AS too_long FROM sized GROUP BY source_id""",
    "shuffled_documents": with_(DOC_KEYS) + f"SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY {order_key('source_id', 'id')}, id) - 1 AS rank FROM keys",
    "buffered_shuffle": with_(DOC_KEYS, *BUFFERED) + "SELECT id, source_id, rank FROM ranked",
    "source_shares": "SELECT lang AS source_id, count(*) AS weight, round(count(*)/sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang",
    "interleave_all_exhausted": with_(*DOC_MIX) + "SELECT source_id, pos, pass, id FROM mixed",
    "interleave_first_exhausted": with_(*mixed(DOC_KEYS, DOC_STEPS, "first_exhausted", DOC_SLOTS)) + "SELECT source_id, pos, pass, id FROM mixed",
    "interleave_conversations": with_(*CONV_MIX) + "SELECT source_id, pos, pass, id FROM mixed",
    "single_source_order": f"SELECT doc_id AS id, row_number() OVER (ORDER BY {order_key(chr(39) + 'all' + chr(39), 'doc_id')}, doc_id) - 1 AS pos FROM documents",
    "length_positions": "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents",
    "batches_plain": with_(*PLANNED) + "SELECT pos, id, pos//4 AS batch_id FROM planned",
    "batches_filter_before": with_(*PLANNED) + ", dense AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id FROM planned WHERE valid) SELECT pos, id, pos//4 AS batch_id FROM dense",
    "batches_filter_after": with_(*PLANNED) + "SELECT pos, id, pos//4 AS batch_id FROM planned WHERE valid",
    "batches_without_rows": with_(*PLANNED) + "SELECT pos//2 AS batch_id FROM planned GROUP BY 1 HAVING NOT bool_or(valid AND id%2=0)",
    "rank_shards": with_(*DOC_MIX) + """, n AS (SELECT count(*) AS n FROM mixed), spread AS (SELECT unnest(range(((n+6)//7)*7)) AS pos, n FROM n)
        SELECT s.pos, id, s.pos%7 AS rank, s.pos//7//4 AS batch_in_rank, s.pos//7//4%2 AS worker FROM spread s JOIN mixed m ON m.pos=s.pos%n""",
    "optimizer_steps": with_(*DOC_MIX) + """, n AS (SELECT count(*) AS n FROM mixed), spread AS (SELECT unnest(range(((n+1)//2)*2)) AS pos, n FROM n)
        SELECT s.pos, id, s.pos%2 AS rank, s.pos//2 AS batch_in_rank, s.pos//2//4 AS step FROM spread s JOIN mixed m ON m.pos=s.pos%n WHERE s.pos//2//4<100""",
    "mixture_shares": with_(*DOC_MIX) + "SELECT source_id, count(*) AS rows, count(DISTINCT id) AS distinct_samples, count(*)-count(DISTINCT id) AS repeats, round(count(*)/sum(count(*)) OVER (), 6) AS realised, CASE source_id WHEN 'en' THEN 0.125 WHEN 'es' THEN 0.375 ELSE 0.25 END::DOUBLE AS requested FROM mixed GROUP BY source_id",
    "training_rows": training(PROMPT, "conv"),
    "training_rows_strict": training(PROMPT_STRICT, "prompts", steps=[("1", 2 / 3), ("2", None)]),
    "training_rows_legacy": training(PROMPT_LEGACY, "conv"),
    "training_rows_interleaved": training(PROMPT_INTERLEAVED, "conv", fixed.SPECIAL_TOKENS["interleaved"], 151655, (DYNAMIC,)),
    "epoch_loss": with_(METRIC) + "SELECT run, epoch, count(*) AS steps, sum(batch_size)::BIGINT AS samples, round(sum(loss*batch_size)/sum(batch_size), 6) AS loss FROM metric GROUP BY run, epoch",
    "step_loss": with_(METRIC) + "SELECT run, step//4 AS optimizer_step, count(*) AS micro_batches, round(avg(loss), 6) AS loss FROM metric GROUP BY 1, 2",
    "thinned_log": with_(METRIC) + "SELECT * FROM metric WHERE (step+1)%50=0",
    "stream_prepare": with_(*DOC_STREAM) + """SELECT doc_id AS id, n_slots, n_tokens, least(n_tokens, 1024) AS n_pieces, md5(prompt) AS prompt_md5,
        md5(array_to_string(flatten(list_transform(pieces, lambda x: CASE WHEN x='<image>' THEN list_resize([x], coalesce(n_visual, 1), x) ELSE [x] END))[1:1024], chr(31))) AS pieces_md5 FROM doc_ready""",
    "stream_batches": with_(
        *DOC_STREAM, vocab("doc_ready", WORDS), ids_of("doc_ready", "doc_id"),
        """grown AS (SELECT doc_id, flatten(list_transform(ids, lambda x: CASE WHEN x=151646 THEN list_resize([x], coalesce(n_visual, 1), x)
          ELSE [x] END))[1:1024] AS ids FROM ids JOIN doc_ready USING (doc_id))""",
        *mixed("keys AS (SELECT doc_id AS id, lang AS source_id FROM doc_ready)", DOC_STEPS, "all_exhausted", DOC_SLOTS, BUFFERED),
        "cut AS (SELECT pos, pass, id, source_id, pos//8 AS batch_id, ids FROM mixed JOIN grown ON doc_id=id)",
        "wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM cut)",
    ) + f"SELECT pos, pass, id, source_id, batch_id, width, len(ids) AS length, md5({text('ids || list_resize([]::BIGINT[], width-len(ids), -100)')}) AS labels_md5 FROM wide",
    "stream_rejects": with_(DOC_SAMPLE) + "SELECT lang AS source_id, 'no_assistant_text' AS reject_reason, count(*) AS rejects FROM doc WHERE told='' GROUP BY lang",
    "stream_reject_updates": with_(DOC_SAMPLE) + "SELECT lang AS source_id, 'no_assistant_text' AS reject_reason, count(*) AS rejects FROM doc WHERE told='' GROUP BY lang",
    "stream_outcomes": with_(*DOC_STREAM) + """SELECT 'accepted' AS outcome, doc_id AS id, NULL AS reject_reason, n_tokens, md5(prompt) AS prompt_md5 FROM doc_ready
        UNION ALL SELECT 'rejected', doc_id, 'no_assistant_text', NULL, NULL FROM doc WHERE told=''""",
    "keyed_turns": """SELECT conv_id, NULL AS role, NULL AS reject_reason, count(*) AS n_turns FROM conversations WHERE (conv_id+turn)%3<>0 GROUP BY conv_id
        UNION ALL SELECT NULL, role, 'null_key', count(*) FROM conversations WHERE (conv_id+turn)%3=0 GROUP BY role""",
}
