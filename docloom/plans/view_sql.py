"""The views of `views`, and steps that several checks share, as SQL common table expressions."""

from __future__ import annotations

from docloom.functions import fixed_values as fv


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def tokens(text: str) -> str:
    dropped = [w for w in fv.STOPWORDS if w not in fv.BUSINESS_TERMS]
    return (
        rf"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2"
        rf" and w not in ({listed(dropped)}) and not regexp_full_match(w, '\p{{Nd}}+'))"
    )


def matches(text: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {quoted(pattern)})"


def lowered(values: str) -> str:
    return f"list_transform({values}, lambda e: lower(e))"


def keywords(text: str) -> str:
    found = (
        f"list_concat({lowered(matches(text, fv.EMAIL_IN_TEXT))}, {matches(text, fv.PHONE_IN_TEXT)},"
        f" {lowered(matches(text, fv.URL_IN_TEXT))}, {matches(text, fv.PRICE_IN_TEXT)})"
    )
    parts = f"flatten(list_transform({found}, lambda e: string_split(translate(lower(e), '_-', '  '), ' ')))"
    return f"list_distinct(list_concat({tokens(text)}, list_filter({parts}, lambda p: length(p) > 2)))"


def base_name(path: str) -> str:
    return f"list_last(string_split({path}, '/'))"


def suffix(path: str) -> str:
    return rf"lower(regexp_extract({path}, '[^/](\.[^./]+)$', 1))"


def case_of(mapping: dict, key: str) -> str:
    return f"case {key} " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in mapping.items()) + " end"


def filled(value: str) -> str:
    return f"coalesce({value} <> '', false)"


def nonzero(value: str) -> str:
    return f"coalesce({value} <> 0, false)"


def has(value: str) -> str:
    return f"coalesce(len({value}) > 0, false)"


SAFE = r"regexp_replace(member_path, '^[/\\]+', '')"
HEADER = "upper(hex(header))"


def magic(path: str) -> str:
    packed = (
        f"coalesce({case_of(fv.TYPE_BY_EXTENSION, suffix(path))},"
        " case when list_bool_or(list_transform(inner_names, lambda n: contains(n, 'word/'))) then 'docx'"
        " when list_bool_or(list_transform(inner_names, lambda n: contains(n, 'xl/'))) then 'xlsx' end)"
    )
    riff = f"case when length({HEADER}) > 24 then {case_of(fv.RIFF_KIND, f'substring({HEADER}, 17, 8)')} end"
    plain = " ".join(f"when starts_with({HEADER}, '{k}') then '{v}'" for k, v in fv.TYPE_BY_MAGIC.items())
    return (
        f"case when starts_with({HEADER}, '{fv.ZIP_MAGIC}') then {packed}"
        f" when starts_with({HEADER}, '{fv.RIFF_MAGIC}') then {riff} {plain} end"
    )


def category(file_type: str) -> str:
    return "case " + " ".join(
        f"when {file_type} in ({listed(types)}) then '{name}'" for name, types in fv.CATEGORY_TYPES.items()
    ) + " else 'unknown' end"


def header_test(kind: str, table: str = "cells") -> str:
    words = "|".join(fv.TABLE_HEADER_WORDS[kind])
    return f"coalesce(list_bool_or(list_transform({table}[1], lambda h: regexp_matches(lower(h), '{words}'))), false)"


FIRST_ROWS = "lower(array_to_string(flatten(cells[2:3]), ' '))"
PRICING = f"({header_test('pricing')} or regexp_matches({FIRST_ROWS}, {quoted(fv.CURRENCY_IN_CELLS)}))"
ITINERARY = f"({header_test('itinerary')} or regexp_matches({FIRST_ROWS}, {quoted(fv.TIME_IN_CELLS)}))"
FILLED_CELLS = "len(list_filter(flatten(cells), lambda c: trim(c) <> ''))"
VALID = f"(len(cells) >= 2 and len(cells[1]) >= 1 and coalesce({FILLED_CELLS} / nullif(len(flatten(cells)), 0) >= 0.3, false))"

_PRICE = "floor(o_totalprice)::bigint"
_K, _P, _C = "o_orderkey", "p_partkey", "c_custkey"
_EVENT = (
    """'{"description": "Event ' || event_id || '", "category": " ' || upper(event_type)"""
    """ || '", "tags": ["t' || (user_id % 7) || '", "' || event_type || '"], "is_product": '"""
    """ || case when event_id % 2 = 0 then 'true' else 'false' end"""
    """ || ', "price": ' || case when event_id % 3 = 0 then '0' else (event_id % 50)::varchar end"""
    """ || ', "policies": {"cancellation": "c' || (event_id % 4) || '"}, "confidence": 0.' || (10 + event_id % 90)"""
    """ || ', "details": {"size": "s' || (event_id % 5) || '", "seats": ' || (event_id % 9) || '}, "inclusions": ["i'"""
    """ || (event_id % 3) || '", "lunch"], "exclusions": ["x' || (user_id % 3) || '"], "faqs": [{"question": "q'"""
    """ || (event_id % 2) || '", "answer": "a"}], "email": "e' || (user_id % 9) || '@example.com"}'"""
)

# name -> SQL; a definition may use the names before it
DEFINITIONS: dict[str, str] = {
    "v_pages": """
        select 'd' || doc_id as doc_id,
            source || '/doc_' || doc_id || case when doc_id % 2 = 1 then '.docx' else '.pdf' end as source_file,
            1::bigint as page_number, text from documents
        union all
        select 'c' || conv_id, 'conversations/conv_' || conv_id || '.pdf', turn + 1, text from conversations""",
    "v_questions": """
        select item_id as query_id,
            text || case when item_id % 2 = 0 then ' price hours contact' else '' end as query from benchmark""",
    "v_members": r"""
        select regexp_extract(url, '^https?://([^/]+)', 1) as job_id,
            (['../','C:\','//','\docs\','a..b/','/abs//x/','','','','',''])[page_id % 11 + 1] || tail
                || case when tail like '%/' then '' else '_' || page_id ||
                (['.pdf','.doc','.docx','.xls','.xlsx','.csv','.jpg','.jpeg','.png','.gif','.webp',
                  '.mp4','.avi','.mov','.mkv','.txt','','.PDF','.qt'])[page_id % 19 + 1] end as member_path,
            case when page_id % 13 = 0 then 0 else length(html) end::bigint as member_size,
            unhex((['255044462D312E34','D0CF11E0A1B11AE1','504B030414000600','FFD8FFE000104A46','89504E470D0A1A0A',
              '474946383961','52494646000000005745425056503820','68656C6C6F'])[page_id % 8 + 1]) as header,
            ([['word/document.xml'], ['xl/workbook.xml'], ['data.txt']])[page_id % 3 + 1] as inner_names,
            case page_id % 10 when 0 then 'application/pdf' when 1 then 'text/plain' end as sniffed_mime
        from (select *, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as tail from pages)""",
    "v_archives": """
        select job_id, (case length(job_id) % 4 when 0 then greatest(1, n // 2000) when 1 then n * 40000
            else n // 4 + 1 end)::bigint as archive_size
        from (select regexp_extract(url, '^https?://([^/]+)', 1) as job_id, sum(length(html))::bigint as n
              from pages group by 1)""",
    "v_paths": rf"""
        select *, case when not contains(rel, '..') and not regexp_matches(rel, '(?s)^.:')
                and regexp_replace(replace(rel, '\', '/'), '/{{2,}}', '/', 'g') not in ('', '.')
            then regexp_replace(replace(rel, '\', '/'), '/{{2,}}', '/', 'g') end as path
        from (select *, {SAFE} as rel from v_members)""",
    "v_checked": """
        select a.job_id, a.archive_size, m.members, m.unpacked_bytes,
            case when archive_size > 524288000 then 'archive size exceeds maximum'
                when members is null then 'invalid or corrupted archive'
                when members > 100 then 'too many files in archive'
                when archive_size > 0 and unpacked_bytes / archive_size > 1000 then 'suspicious compression ratio'
            end as reject_reason
        from v_archives a left join (select job_id, count(*) as members, sum(member_size)::bigint as unpacked_bytes
            from v_members group by 1) m using (job_id)""",
    "v_accepted": "select * from v_paths where path is not null and not ends_with(member_path, '/') and member_size > 0",
    "v_typed": f"""
        select *, coalesce({case_of(fv.TYPE_BY_MIME, 'sniffed_mime')}, {case_of(fv.TYPE_BY_EXTENSION, suffix('path'))},
            {magic('path')}, {case_of(fv.TYPE_BY_MIME, case_of(fv.MIME_BY_EXTENSION, suffix('path')))}, 'unknown') as file_type
        from v_accepted""",
    "v_files": f"""
        select job_id, path, member_size as file_size, file_type, {category('file_type')} as category,
            'file_' || substring(sha256(job_id || chr(10) || path), 1, 12) as file_id
        from v_typed where job_id in (select job_id from v_checked where reject_reason is null)""",
    "v_table_pages": rf"""
        select 'o' || o_custkey as doc_id, 'orders/cust_' || o_custkey || '.pdf' as source_file,
            {_K} + 1 as page_number,
            'Order ' || {_K} || ' has priority ' || o_orderpriority || ' and status ' || o_orderstatus as text,
            [[
              ([['Voyage','Price of a berth','Berths left'], ['Leg','Day of travel','Harbour'], ['Engine','Specification','Unit'],
                ['Dish','Course','Category'], ['Barrel ','Stock','Cellar'], ['Left half','Right half',null],
                ['House menu','Feature','Season'], ['Separate','  Note  ','Kind']])[{_K} % 8 + 1],
              [' ' || o_orderpriority || '  ',
               case when {_K} % 3 = 0 then '$ ' || {_PRICE} else {_PRICE}::varchar end,
               case when {_K} % 7 = 0 then null else o_orderstatus end],
              [case when {_K} % 9 = 0 then 'Day ' || ({_K} % 30) else 'Entry' || chr(9) || ' ' || {_K} end, '', 'x'],
              [null, '', '   '],
              case when {_K} % 5 = 0 then null
                else ['End', case when {_K} % 16 = 5 then '9:30 am' end, null] end],
             [['Total', 'Status']],
             case when {_K} % 2 = 0 then [['', 'x', ''], [null, '', 'y']]
                else [['', 'x', '', '', ''], ['y', '', '', '', ' ']] end] as tables,
            {_K} % 3 as n_images
        from orders""",
    "v_raw": """
        select doc_id, source_file, page_number, text, (i - 1)::bigint as table_index, tables[i] as raw,
            'tbl_' || doc_id || '_p' || page_number || '_' || (i - 1) as table_id
        from v_table_pages, (select unnest([1, 2, 3]) as i)""",
    "v_clean": r"""
        select *, list_filter(list_transform(list_filter(raw, lambda r: r is not null), lambda r:
                list_transform(r, lambda c: trim(regexp_replace(coalesce(c, ''), '\s+', ' ', 'g')))),
            lambda r: len(list_filter(r, lambda c: c <> '')) > 0) as cells
        from v_raw""",
    "v_tables": f"""
        select *, case when {PRICING} then 'pricing' when {ITINERARY} then 'itinerary'
            when {header_test('specifications')} then 'specifications' when {header_test('menu')} then 'menu'
            when {header_test('inventory')} then 'inventory' else 'general' end as table_type
        from v_clean where {VALID}""",
    "v_keywords": f"select doc_id, page_number, unnest({keywords('text')}) as keyword from v_pages",
    "v_hits": f"""
        select *, (length(lt) - length(replace(lt, keyword, ''))) // length(keyword) as n, strpos(lt, keyword) as position
        from (select doc_id, page_number, source_file, text, lower(text) as lt, unnest({keywords('text')}) as keyword
              from v_pages)""",
    "v_postings": f"""
        select doc_id, page_number, keyword, position::bigint as position, round(least(least(n * 0.2::double, 0.6::double)
            + case when keyword in ({listed(fv.BUSINESS_TERMS)}) then 0.2::double else 0 end
            + case when contains(substring(lt, 1, 500), keyword) then 0.2::double else 0 end, 1.0::double), 6) as relevance
        from v_hits""",
    "v_snippets": f"""
        select doc_id, page_number, keyword, case when position = 0 then substring(text, 1, 200) else
            trim(replace(case when position - 101 > 0 then '...' else '' end
                || substring(text, greatest(0, position - 101) + 1,
                    least(length(text), position - 1 + length(keyword) + 100) - greatest(0, position - 101))
                || case when position - 1 + length(keyword) + 100 < length(text) then '...' else '' end,
                chr(10), ' '), {BLANKS}) end as snippet
        from v_hits""",
    "v_synonyms": "select * from (values "
    + ", ".join(f"('{k}', '{s}')" for k, v in fv.SYNONYMS.items() for s in v)
    + ") as s(keyword, synonym)",
    "v_base_terms": f"select query_id, unnest({keywords('query')}) as keyword from v_questions",
    "v_all_terms": """
        select query_id, keyword from v_base_terms
        union select query_id, synonym from v_base_terms join v_synonyms using (keyword)""",
    "v_terms": "select query_id, keyword, count(*) over (partition by query_id) as n_terms from v_all_terms",
    "v_found": """
        select query_id, n_terms, p.* from v_terms t join v_postings p using (keyword)""",
    "v_matched": """
        select query_id, doc_id, page_number, round(sum(relevance), 6) as score, count(*) as terms_found,
            max(n_terms) as n_terms,
            arg_min(keyword, {'r': -relevance, 'k': keyword}) as best_keyword
        from v_found group by all""",
    "v_ranked": """
        select *, row_number() over (partition by query_id order by score desc, doc_id, page_number) as rank
        from v_matched""",
    "v_top": "select * from v_ranked where rank <= 5",
    "v_images": """
        select 'img_' || vec_id as image_id, vec_id as seq, 'job_' || label as job_id, 'd' || vec_id as source_doc,
            1::bigint as source_page,
            ([1920,1280,640,100,800,3000,2000,640,500])[vec_id % 9 + 1] as width,
            ([1080,720,480,100,600,1000,2000,427,0])[vec_id % 9 + 1] as height,
            1000 + (vec_id * 37) % 5000 as file_size,
            (['standalone','embedded_pdf','embedded_docx'])[vec_id % 3 + 1] as extraction_method,
            vec_id % 3 <> 0 as is_embedded,
            'images/img_' || vec_id || (['.jpg','.JPEG','.png','.bmp','.tiff'])[vec_id % 5 + 1] as file_path,
            array_to_string(list_transform(embedding[1:8], lambda x: case when x > 0 then '1' else '0' end), '') as content,
            array_to_string(list_transform(embedding, lambda x: case when x::double > 0.15 then '1' else '0' end), '')::bit
                as bits
        from embeddings""",
    "v_near": """
        select a.job_id, a.seq as earlier, b.seq as later
        from (select job_id, bits, min(seq) as seq from v_images group by all) a
        join (select job_id, bits, min(seq) as seq from v_images group by all) b
          on a.job_id = b.job_id and a.seq < b.seq and bit_count(xor(a.bits, b.bits)) < 5""",
    "v_quality": """
        select *, case when width * height >= 2073600 then 'high' when width * height >= 921600 then 'medium'
                when width * height >= 307200 then 'low' else 'very_low' end as resolution,
            case when width * height >= 2073600 then 1.0 when width * height >= 921600 then 0.7
                when width * height >= 307200 then 0.5 else 0.3 end::double as base,
            list_min([abs(16::double / 9 - r), abs(4::double / 3 - r), abs(1 - r), abs(1.5 - r)]) as gap
        from (select *, case when height > 0 then width::double / height else 1.0::double end as r from v_images)""",
    "v_analyses": """
        select 'img_' || p_partkey as image_id, 'job_' || (p_partkey // 100) as job_id,
            'Photo of a ' || p_name || ' from ' || p_brand as description,
            (['product','service','food','destination','person','document','logo','other'])[p_size % 8 + 1] as category,
            [string_split(p_name, ' ')[1], lower(p_type), p_brand] as tags,
            case when p_partkey % 4 = 0 then [p_type || ' set'] else []::varchar[] end as suggested,
            p_size % 2 = 0 as is_product, p_size % 3 = 0 as is_service_related,
            'd' || (p_partkey % 50) as source_doc, 1::bigint as source_page
        from part""",
    "v_items": """
        select 'job_' || (p_partkey // 100) as job_id, p_partkey as item_id,
            case when p_partkey % 6 = 0 then lower(p_type) else p_name end as name,
            case when p_partkey % 5 = 0 then []::varchar[] else [upper(string_split(p_name, ' ')[1]), p_type] end as tags,
            'd' || (p_partkey * 7 % 50) as doc_id, 1::bigint as page_number
        from part""",
    "v_overlap": """
        select i.job_id, i.item_id, a.image_id, a.is_product, a.is_service_related,
            case when len(i.tags) = 0 or len(a.tags) = 0 then 0::double else
                len(list_intersect(list_distinct(list_transform(i.tags, lambda t: lower(t))), list_transform(a.tags, lambda t: lower(t))))
                / len(list_distinct(list_concat(list_transform(i.tags, lambda t: lower(t)), list_transform(a.tags, lambda t: lower(t)))))
            end as overlap,
            contains(lower(a.description), lower(i.name))
                or coalesce(list_bool_or(list_transform(a.suggested, lambda s: contains(lower(s), lower(i.name)))), false) as named,
            i.doc_id = a.source_doc and i.page_number = a.source_page as same_page
        from v_items i join v_analyses a using (job_id)""",
    "v_docs": """
        select distinct 'job_' || (conv_id // 10) as job_id, 'c' || conv_id as doc_id, conv_id as doc_order
        from conversations
        union all select distinct 'job_' || (doc_id // 10), 'd' || doc_id, doc_id + 1099511627776 from documents""",
    "v_full": f"""
        select doc_id, string_agg('[Page ' || page_number || ']' || chr(10) || text, chr(10) || chr(10) order by page_number)
            as text
        from v_pages where trim(text, {BLANKS}) <> '' group by doc_id""",
    "v_profiles": f"""
        select {_C} as profile_id, 'job_' || {_C} as job_id,
            (['product','service','mixed','service'])[{_C} % 4 + 1] as business_type,
            '2024-01-' || lpad((1 + {_C} % 28)::varchar, 2, '0') as saved_at,
            {_C} % 29 <> 0 as here,
            case when {_C} % 29 = 0 or {_C} % 19 = 0 and {_C} % 17 <> 0 then null when {_C} % 17 = 0 then '' else c_name end as name,
            case when {_C} % 29 = 0 or {_C} % 5 = 0 then null when {_C} % 5 = 1 then 'Short text'
                else 'A ' || lower(c_mktsegment) || ' business from ' || n_name || ' in ' || r_name end as description,
            case when {_C} % 29 <> 0 then c_mktsegment end as category,
            {_C} % 29 <> 0 and {_C} % 13 <> 0 as has_location,
            case when {_C} % 29 <> 0 and {_C} % 13 <> 0 and {_C} % 2 = 0 then 'Street ' || {_C} end as address,
            case when {_C} % 29 <> 0 and {_C} % 13 <> 0 and {_C} % 3 = 0 then n_name end as city,
            case when {_C} % 29 <> 0 and {_C} % 13 <> 0 and {_C} % 5 = 0 then r_name end as country,
            case when {_C} % 29 = 0 or {_C} % 23 = 0 then null else case {_C} % 3 when 0 then '555-' || {_C}
                when 1 then '(555) 123 ' || ({_C} + 1000) end end as phone,
            case when {_C} % 29 = 0 or {_C} % 23 = 0 then null else case {_C} % 7 when 0 then 'bad email' when 1 then null
                else 'c' || {_C} || '@example.com' end end as email,
            case when {_C} % 29 = 0 or {_C} % 23 = 0 then null else case {_C} % 4 when 0 then 'www.x.com' when 1 then null
                else 'https://example.com/' || {_C} end end as website,
            {_C} % 29 <> 0 and {_C} % 11 <> 0 as has_hours, {_C} % 9 <> 0 as has_monday
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "v_services": f"""
        select o_custkey as profile_id, {_K} as ordinal, 'svc_' || {_K} as service_id,
            case when {_K} % 6 = 0 then null else 'Service ' || {_K} end as name,
            case {_K} % 5 when 0 then null when 1 then 'Tiny' else 'Service with priority ' || o_orderpriority end as description,
            o_orderstatus as category,
            case {_K} % 10 when 0 then -o_totalprice when 1 then o_totalprice * 100 when 2 then 0 when 3 then null
                else o_totalprice end as base_price,
            case {_K} % 8 when 0 then -1 when 1 then o_totalprice * 200 when 2 then 5 end::double as discount_price,
            case when {_K} % 3 = 0 then 'USD' end as currency,
            {_K} % 3 as details_kind,
            case when {_K} % 4 = 0 then ['Day 1', 'Day 2'] end as itinerary,
            case when {_K} % 2 = 0 then string_split(o_orderpriority, '-') end as inclusions,
            case when {_K} % 7 = 0 then ['flights'] end as exclusions,
            case when {_K} % 3 = 1 then 'Free until the day before' end as cancellation_policy,
            case when {_K} % 5 = 2 then 'Half in advance' when {_K} % 5 = 3 then '' end as payment_policy,
            case when {_K} % 11 = 0 then 'By bus' end as travel_info,
            case when {_K} % 9 = 0 then ['Question 1', 'Question 2', 'Question 3'] end as faqs,
            case when {_K} % 2 = 1 then [o_orderstatus, o_orderpriority] else [o_orderstatus] end as tags
        from orders""",
    "v_products": f"""
        select p_size::bigint as profile_id, {_P} as ordinal, 'prd_' || {_P} as product_id,
            case when {_P} % 7 = 0 then '' else p_name end as name,
            case when {_P} % 3 = 0 then null else p_type || ' part' end as description,
            case {_P} % 9 when 0 then -p_retailprice when 1 then p_retailprice * 2000 when 2 then null
                else p_retailprice end as base_price,
            case {_P} % 4 when 0 then p_retailprice * 2 when 1 then -2 end::double as discount_price,
            {_P} % 2 = 0 as has_specifications
        from part""",
    "v_own_findings": rf"""
        select profile_id, unnest(list_filter([
            case when not here then {{'field': 'business_info', 'error_type': 'missing',
                'message': 'Business information is missing', 'severity': 'error'}} end,
            case when here and not {filled('name')} then {{'field': 'business_info.name', 'error_type': 'missing',
                'message': 'Business name not found', 'severity': 'warning'}} end,
            case when here and not {filled('description')} then {{'field': 'business_info.description',
                'error_type': 'missing', 'message': 'Business description not found', 'severity': 'warning'}} end,
            case when {filled('description')} and length(description) < 20 then {{'field': 'business_info.description',
                'error_type': 'too_short', 'message': 'Business description is too short (< 20 chars)', 'severity': 'warning'}} end,
            case when {filled('email')} and not regexp_matches(email, {quoted(fv.EMAIL_ADDRESS)}) then
                {{'field': 'business_info.contact.email', 'error_type': 'invalid_format',
                'message': 'Invalid email format: ' || email, 'severity': 'error'}} end,
            case when {filled('phone')} and length(regexp_replace(phone, '\D', '', 'g')) < 7 then
                {{'field': 'business_info.contact.phone', 'error_type': 'invalid_format',
                'message': 'Phone number format may be invalid: ' || phone, 'severity': 'warning'}} end,
            case when {filled('website')} and not regexp_matches(website, {quoted(fv.WEB_ADDRESS)}) then
                {{'field': 'business_info.contact.website', 'error_type': 'invalid_format',
                'message': 'Website URL may be invalid: ' || website, 'severity': 'warning'}} end,
            case when has_location and address is null and city is null and country is null then
                {{'field': 'business_info.location', 'error_type': 'incomplete',
                'message': 'Location has no address, city, state, or country', 'severity': 'warning'}} end,
            case when has_hours and not has_monday then {{'field': 'business_info.working_hours', 'error_type': 'missing',
                'message': 'No working hours specified', 'severity': 'warning'}} end
            ], lambda f: f is not null)) as f from v_profiles""",
    "v_price_findings": """
        with priced as (select profile_id, 'services[' || ordinal || '].pricing.' as place, base_price, discount_price from v_services
            union all select profile_id, 'products[' || ordinal || '].pricing.', base_price, discount_price from v_products)
        select profile_id, place || 'base_price' as field, 'invalid_value' as error_type,
            'Base price cannot be negative' as message, 'error' as severity from priced where base_price < 0
        union all select profile_id, place || 'base_price', 'suspicious_value', 'Base price seems very high: ' || base_price,
            'warning' from priced where base_price > 1000000
        union all select profile_id, place || 'discount_price', 'invalid_value', 'Discount price cannot be negative', 'error'
            from priced where discount_price < 0
        union all select profile_id, place || 'discount_price', 'invalid_value',
            'Discount price cannot be higher than base price', 'error'
            from priced where discount_price >= 0 and base_price <> 0 and discount_price > base_price""",
    "v_name_findings": f"""
        select profile_id, 'products[' || ordinal || '].name' as field, 'missing' as error_type,
            'Product ' || (ordinal + 1) || ' has no name' as message, 'warning' as severity
        from v_products where not {filled('name')}
        union all select profile_id, 'services[' || ordinal || '].name', 'missing',
            'Service ' || (ordinal + 1) || ' has no name', 'warning' from v_services where not {filled('name')}
        union all select profile_id, 'services[' || ordinal || '].description', 'missing',
            'Service ' || (ordinal + 1) || ' has no description', 'warning' from v_services where not {filled('description')}""",
    "v_missing_items": """
        select profile_id, 'products' as field, 'missing' as error_type, 'Product business has no products' as message,
            'warning' as severity from v_profiles where business_type in ('product', 'mixed')
            and profile_id not in (select profile_id from v_products)
        union all select profile_id, 'services', 'missing', 'Service business has no services', 'warning' from v_profiles
            where business_type in ('service', 'mixed') and profile_id not in (select profile_id from v_services)""",
    "v_findings": """
        select profile_id, f.severity as severity from v_own_findings
        union all select profile_id, severity from v_missing_items
        union all select i.profile_id, i.severity
            from (select * from v_price_findings union all select * from v_name_findings) i join v_profiles p using (profile_id)
            where business_type = 'mixed' or business_type = case when i.field like 'services%' then 'service' else 'product' end""",
    "v_scores": f"""
        select p.profile_id, p.job_id,
            least((case when {filled('p.name')} then 2 else 0 end + case when {filled('p.description')} then 1 else 0 end
              + case when {filled('email')} then 0.5 else 0 end + case when {filled('phone')} then 0.5 else 0 end
              + case when {filled('city')} then 0.5 else 0 end + case when {filled('address')} then 0.5 else 0 end)::double / 5, 1)
              as business_info,
            coalesce(ps.score, 0) as products, coalesce(ss.score, 0) as services
        from v_profiles p
        left join (select profile_id, avg(0::double + case when {filled('name')} then 0.3::double else 0 end
            + case when {filled('description')} then 0.2::double else 0 end + case when {nonzero('base_price')} then 0.3::double else 0 end
            + case when has_specifications then 0.2::double else 0 end) as score from v_products group by 1) ps using (profile_id)
        left join (select profile_id, avg(0::double + case when {filled('name')} then 0.25 else 0 end
            + case when {filled('description')} then 0.25 else 0 end + case when {nonzero('base_price')} then 0.25 else 0 end
            + case when details_kind = 0 or {has('itinerary')} then 0.25 else 0 end) as score
            from v_services group by 1) ss using (profile_id)""",
    "v_complete": """
        select *, round(least(business_info * 0.4::double + products * 0.3::double + services * 0.3::double, 1), 9) as completeness
        from v_scores""",
    "v_valid": """
        select p.profile_id, p.job_id, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings,
            coalesce(errors, 0) = 0 as is_valid
        from v_profiles p left join (select profile_id, count(*) filter (severity = 'error') as errors,
            count(*) filter (severity = 'warning') as warnings from v_findings group by 1) using (profile_id)""",
    "v_jobs": "select 'job_' || c_custkey as job_id from customer union all select 'supplier_' || s_suppkey from supplier",
    "v_store": """
        select 'job_' || c_custkey as job_id, c_name as business_name, c_mktsegment as category,
            case when c_acctbal < 0 then 2 else 1 end::bigint as version, '2024-01-01' as saved_at from customer""",
    "v_edits": """
        select 'job_' || case when s_nationkey < 5 then 's' else '' end || s_suppkey as job_id, s_name as business_name,
            'EDITED' as category from supplier""",
    "v_dense": """
        select profile_id, row_number() over (partition by profile_id order by ordinal) - 1 as ordinal, name, category,
            'svc_' || (row_number() over (partition by profile_id order by ordinal) - 1) as service_id from v_services""",
    "v_item_maps": """
        select profile_id, ordinal, unnest([{'key': 'name', 'value': name}, {'key': 'description', 'value': description},
            {'key': 'category', 'value': category}, {'key': 'cancellation_policy', 'value': cancellation_policy},
            {'key': 'payment_policy', 'value': payment_policy},
            {'key': 'grade', 'value': case when ordinal % 4 = 0 then '' end}, {'key': '_internal', 'value': 'x'}]) as kv
        from v_services""",
    "v_events": """
        select user_id as job_id, event_id, ts,
            case event_type when 'click' then 'file_discovery' when 'view' then 'document_parsing'
                when 'purchase' then 'schema_mapping' when 'signup' then 'done' end as phase,
            case event_type when 'signup' then 'completed' when 'error' then 'failed' else 'processing' end as status,
            case when event_type = 'error' then props end as error
        from events""",
    "v_status": """
        select job_id, s.status as status, phase, case when s.status = 'completed' then 100.0 else coalesce(case phase
            when 'file_discovery' then 10.0 when 'document_parsing' then 30.0 when 'schema_mapping' then 95.0
            when 'done' then 100.0 end, 0.0) end::double as progress, s.error as error
        from (select job_id, arg_max({'status': status, 'error': error}, {'ts': ts, 'id': event_id}) as s,
              arg_max(phase, {'ts': ts, 'id': event_id}) filter (phase is not null) as phase from v_events group by 1)""",
    "v_durations": """
        select job_id, event_id, phase, (epoch_us(lead(ts) over (partition by job_id order by ts, event_id)) - epoch_us(ts))
            / 1000000 as seconds from v_events""",
    "v_responses": f"""
        select 'img_' || event_id as image_id, event_id as doc_id,
            'Offer No ' || event_id || case when event_id % 2 = 0 then '.pdf' else '.docx' end as doc_name,
            record, event_id % 6 as kind,
            case event_id % 6 when 0 then record when 1 then 'Here it is: ' || record || ' Hope it helps.'
                when 2 then 'Sure.' || chr(10) || '```json' || chr(10) || record || chr(10) || '```' || chr(10) || 'Done'
                when 3 then '{{"description": broken ' || event_id
                when 4 then '```' || chr(10) || '[1, ' || record || ', {{"description": "second"}}]' || chr(10) || '```' end as response,
            case when event_id % 6 = 5 and event_id % 4 = 1 then 'timeout' end as error
        from (select *, {_EVENT} as record from events)""",
    "v_fenced": f"""
        select *, case when json_type(j) = 'ARRAY' then list_filter(j::json[], lambda e: json_type(e) = 'OBJECT')[1]
            when json_type(j) = 'OBJECT' then j end as data
        from (select *, try_cast(trim(case when contains(response, '```') then
            case when starts_with(string_split(response, '```')[2], 'json') then substring(string_split(response, '```')[2], 5)
            else string_split(response, '```')[2] end else response end, {BLANKS}) as json) as j from v_responses)""",
    "v_braced": r"""
        select *, try_cast(case when regexp_extract(response, '(?s)\{.*\}') <> '' then regexp_extract(response, '(?s)\{.*\}')
            else response end as json) as j
        from v_responses where response is not null""",
}


def with_views(sql: str) -> str:
    """The statement with the definitions it uses, and those they use, in front."""
    import re

    names = list(DEFINITIONS)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\bv_\w+", text)) & DEFINITIONS.keys() - needed:
            needed.add(name)
            visit(DEFINITIONS[name])

    visit(sql)
    ctes = ",\n".join(f"{n} as ({DEFINITIONS[n]})" for n in names if n in needed)
    return f"with {ctes}\n{sql}" if ctes else sql
