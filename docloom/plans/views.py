"""Views that shape the driver tables into the operators' input contracts.

Each view reads whole tables with column expressions. `view_sql` holds the same
views for the SQL side.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.sizing import spread

# Ship `pack_pages` with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as one-page files and conversations as files with a page per turn."""
    single = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("doc_id"),
        F.concat(
            "source", F.lit("/doc_"), "doc_id", F.when(F.col("doc_id") % 2 == 1, ".docx").otherwise(".pdf")
        ).alias("source_file"),
        F.lit(1).cast("bigint").alias("page_number"),
        "text",
    )
    several = table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("doc_id"),
        F.concat(F.lit("conversations/conv_"), "conv_id", F.lit(".pdf")).alias("source_file"),
        (F.col("turn") + 1).alias("page_number"),
        "text",
    )
    return spread(single).unionByName(spread(several))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as queries; every second one also asks for business terms."""
    asks = F.when(F.col("item_id") % 2 == 0, F.lit(" price hours contact")).otherwise(F.lit(""))
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat("text", asks).alias("query")
    )


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Crawled pages as archive members: the host is the job, path forms and headers vary by page."""
    extensions = (
        "array('.pdf','.doc','.docx','.xls','.xlsx','.csv','.jpg','.jpeg','.png','.gif','.webp',"
        "'.mp4','.avi','.mov','.mkv','.txt','','.PDF','.qt')"
    )
    prefixes = r"array('../','C:\\','//','\\docs\\','a..b/','/abs//x/','','','','','')"
    headers = (
        "array('255044462D312E34','D0CF11E0A1B11AE1','504B030414000600','FFD8FFE000104A46',"
        "'89504E470D0A1A0A','474946383961','52494646000000005745425056503820','68656C6C6F')"
    )
    tail = r"regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"
    return table(spark, folder, "pages").selectExpr(
        "regexp_extract(url, '^https?://([^/]+)', 1) as job_id",
        f"""concat({prefixes}[page_id % 11], {tail}, case when {tail} like '%/' then ''
            else concat('_', page_id, {extensions}[page_id % 19]) end) as member_path""",
        "case when page_id % 13 = 0 then 0L else cast(length(html) as bigint) end as member_size",
        f"unhex({headers}[page_id % 8]) as header",
        "array(array('word/document.xml'), array('xl/workbook.xml'), array('data.txt'))[page_id % 3] as inner_names",
        "case page_id % 10 when 0 then 'application/pdf' when 1 then 'text/plain' end as sniffed_mime",
    )


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archive sizes per host: some implausibly small, some too large."""
    return (
        table(spark, folder, "pages")
        .selectExpr("regexp_extract(url, '^https?://([^/]+)', 1) as job_id", "length(html) as n")
        .groupBy("job_id")
        .agg(F.sum("n").alias("n"))
        .selectExpr(
            "job_id",
            """case length(job_id) % 4 when 0 then greatest(1L, n div 2000) when 1 then n * 40000
               else n div 4 + 1 end as archive_size""",
        )
    )


def table_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pages with three raw tables each; headers, blanks, nulls and widths vary by order."""
    headers = """array(
        array('Voyage','Price of a berth','Berths left'), array('Leg','Day of travel','Harbour'), array('Engine','Specification','Unit'),
        array('Dish','Course','Category'), array('Barrel ','Stock','Cellar'), array('Left half','Right half',null),
        array('House menu','Feature','Season'), array('Separate','  Note  ','Kind'))[o_orderkey % 8]"""
    price = "cast(floor(o_totalprice) as bigint)"
    first = f"""array(concat(' ', o_orderpriority, '  '),
        case when o_orderkey % 3 = 0 then concat('$ ', {price}) else cast({price} as string) end,
        case when o_orderkey % 7 = 0 then null else o_orderstatus end)"""
    second = r"""array(case when o_orderkey % 9 = 0 then concat('Day ', o_orderkey % 30)
        else concat('Entry\t ', o_orderkey) end, '', 'x')"""
    last = """case when o_orderkey % 5 = 0 then null
        else array('End', case when o_orderkey % 16 = 5 then '9:30 am' end, null) end"""
    sparse = """case when o_orderkey % 2 = 0 then array(array('', 'x', ''), array(null, '', 'y'))
        else array(array('', 'x', '', '', ''), array('y', '', '', '', ' ')) end"""
    return spread(table(spark, folder, "orders")).selectExpr(
        "concat('o', o_custkey) as doc_id",
        "concat('orders/cust_', o_custkey, '.pdf') as source_file",
        "o_orderkey + 1 as page_number",
        "concat('Order ', o_orderkey, ' has priority ', o_orderpriority, ' and status ', o_orderstatus) as text",
        f"""array(array({headers}, {first}, {second}, array(null, '', '   '), {last}),
            array(array('Total', 'Status')), {sparse}) as tables""",
        "slice(array('a', 'b'), 1, cast(o_orderkey % 3 as int)) as images",
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as images: hashes from value signs, sizes and places by id."""
    return table(spark, folder, "embeddings").selectExpr(
        "concat('img_', vec_id) as image_id",
        "vec_id as seq",
        "concat('job_', label) as job_id",
        "concat('d', vec_id) as source_doc",
        "1L as source_page",
        "array(1920,1280,640,100,800,3000,2000,640,500)[vec_id % 9] as width",
        "array(1080,720,480,100,600,1000,2000,427,0)[vec_id % 9] as height",
        "1000 + (vec_id * 37) % 5000 as file_size",
        "array('standalone','embedded_pdf','embedded_docx')[vec_id % 3] as extraction_method",
        "vec_id % 3 <> 0 as is_embedded",
        "concat('images/img_', vec_id, array('.jpg','.JPEG','.png','.bmp','.tiff')[vec_id % 5]) as file_path",
        "array_join(transform(slice(embedding, 1, 8), x -> if(x > 0, '1', '0')), '') as content",
        "cast(conv(array_join(transform(embedding, x -> if(x > 0.15, '1', '0')), ''), 2, -10) as bigint) as hash64",
    ).withColumn("image_hash", F.md5(F.col("content").cast("binary")))


def analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as image analyses."""
    return table(spark, folder, "part").selectExpr(
        "concat('img_', p_partkey) as image_id",
        "concat('job_', p_partkey div 100) as job_id",
        "concat('Photo of a ', p_name, ' from ', p_brand) as description",
        "array('product','service','food','destination','person','document','logo','other')[p_size % 8] as category",
        "array(split(p_name, ' ')[0], lower(p_type), p_brand) as tags",
        "case when p_partkey % 4 = 0 then array(concat(p_type, ' set')) else cast(array() as array<string>) end"
        " as suggested_associations",
        "p_size % 2 = 0 as is_product",
        "p_size % 3 = 0 as is_service_related",
        "concat('d', p_partkey % 50) as source_doc",
        "1L as source_page",
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as products that images may show."""
    return table(spark, folder, "part").selectExpr(
        "concat('job_', p_partkey div 100) as job_id",
        "p_partkey as item_id",
        "case when p_partkey % 6 = 0 then lower(p_type) else p_name end as name",
        "case when p_partkey % 5 = 0 then cast(array() as array<string>)"
        " else array(upper(split(p_name, ' ')[0]), p_type) end as tags",
        "array(struct(concat('d', p_partkey * 7 % 50) as doc_id, 1L as page_number)) as pages",
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as business profiles with gaps and bad values by key."""
    named = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    k = "c_custkey"
    return named.selectExpr(
        f"{k} as profile_id",
        f"concat('job_', {k}) as job_id",
        f"array('product','service','mixed','service')[{k} % 4] as business_type",
        f"concat('2024-01-', lpad(cast(1 + {k} % 28 as string), 2, '0')) as saved_at",
        f"""case when {k} % 29 = 0 then null else struct(
            case when {k} % 17 = 0 then '' when {k} % 19 = 0 then null else c_name end as name,
            case {k} % 5 when 0 then null when 1 then 'Short text'
                else concat('A ', lower(c_mktsegment), ' business from ', n_name, ' in ', r_name) end as description,
            c_mktsegment as category,
            case when {k} % 13 = 0 then null else struct(
                case when {k} % 2 = 0 then concat('Street ', {k}) end as address,
                case when {k} % 3 = 0 then n_name end as city,
                cast(null as string) as state,
                case when {k} % 5 = 0 then r_name end as country) end as location,
            case when {k} % 23 = 0 then null else struct(
                case {k} % 3 when 0 then concat('555-', {k}) when 1 then concat('(555) 123 ', {k} + 1000) end as phone,
                case {k} % 7 when 0 then 'bad email' when 1 then null else concat('c', {k}, '@example.com') end as email,
                case {k} % 4 when 0 then 'www.x.com' when 1 then null
                    else concat('https://example.com/', {k}) end as website) end as contact,
            case when {k} % 11 = 0 then null else struct(
                case when {k} % 9 <> 0 then '9-17' end as monday, '' as tuesday, '' as wednesday, '' as thursday,
                '' as friday, cast(null as string) as saturday, cast(null as string) as sunday) end as working_hours
            ) end as business_info""",
    )


def services(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as services of their customer."""
    k = "o_orderkey"
    return spread(table(spark, folder, "orders")).selectExpr(
        "o_custkey as profile_id",
        f"{k} as ordinal",
        f"concat('svc_', {k}) as service_id",
        f"case when {k} % 6 = 0 then null else concat('Service ', {k}) end as name",
        f"case {k} % 5 when 0 then null when 1 then 'Tiny' else concat('Service with priority ', o_orderpriority) end"
        " as description",
        "o_orderstatus as category",
        f"case {k} % 10 when 0 then -o_totalprice when 1 then o_totalprice * 100 when 2 then 0D when 3 then null"
        " else o_totalprice end as base_price",
        f"case {k} % 8 when 0 then -1D when 1 then o_totalprice * 200 when 2 then 5D end as discount_price",
        f"case when {k} % 3 = 0 then 'USD' end as currency",
        f"case {k} % 3 when 0 then map('duration', concat({k} % 14, ' days'), 'grade', 'easy')"
        " when 1 then cast(map() as map<string,string>) end as details",
        f"case when {k} % 4 = 0 then array('Day 1', 'Day 2') end as itinerary",
        f"case when {k} % 2 = 0 then split(o_orderpriority, '-') end as inclusions",
        f"case when {k} % 7 = 0 then array('flights') end as exclusions",
        f"case when {k} % 3 = 1 then 'Free until the day before' end as cancellation_policy",
        f"case when {k} % 5 = 2 then 'Half in advance' when {k} % 5 = 3 then '' end as payment_policy",
        f"case when {k} % 11 = 0 then 'By bus' end as travel_info",
        f"case when {k} % 9 = 0 then array('Question 1', 'Question 2', 'Question 3') end as faqs",
        f"case when {k} % 2 = 1 then array(o_orderstatus, o_orderpriority) else array(o_orderstatus) end as tags",
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as products; the size is the owning profile, so few profiles own all of them."""
    k = "p_partkey"
    return table(spark, folder, "part").selectExpr(
        "cast(p_size as bigint) as profile_id",
        f"{k} as ordinal",
        f"concat('prd_', {k}) as product_id",
        f"case when {k} % 7 = 0 then '' else p_name end as name",
        f"case when {k} % 3 = 0 then null else concat(p_type, ' part') end as description",
        f"case {k} % 9 when 0 then -p_retailprice when 1 then p_retailprice * 2000 when 2 then null"
        " else p_retailprice end as base_price",
        f"case {k} % 4 when 0 then p_retailprice * 2 when 1 then -2D end as discount_price",
        "cast(null as string) as currency",
        f"case when {k} % 2 = 0 then map('brand', p_brand) end as specifications",
    )


def service_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Services as string maps, the open form the profile page works on."""
    return services(spark, folder).selectExpr(
        "profile_id",
        "ordinal",
        """map('name', name, 'description', description, 'category', category, 'cancellation_policy',
            cancellation_policy, 'payment_policy', payment_policy, 'grade', case when ordinal % 4 = 0 then '' end,
            '_internal', 'x') as item""",
        "details",
    )


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as job progress; the event type gives phase and status."""
    return as_job_events(table(spark, folder, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "user_id as job_id",
        "event_id",
        "ts",
        """case event_type when 'click' then 'file_discovery' when 'view' then 'document_parsing'
            when 'purchase' then 'schema_mapping' when 'signup' then 'done' end as phase""",
        """case event_type when 'signup' then 'completed' when 'error' then 'failed'
            else 'processing' end as status""",
        "case when event_type = 'error' then props end as error",
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Events as model answers: plain, in prose, fenced, broken, and fenced lists."""
    record = (
        """concat('{"description": "Event ', event_id, '", "category": " ', upper(event_type),"""
        """ '", "tags": ["t', user_id % 7, '", "', event_type, '"], "is_product": ',"""
        """ case when event_id % 2 = 0 then 'true' else 'false' end,"""
        """ ', "price": ', case when event_id % 3 = 0 then '0' else cast(event_id % 50 as string) end,"""
        """ ', "policies": {"cancellation": "c', event_id % 4, '"}, "confidence": 0.', 10 + event_id % 90,"""
        """ ', "details": {"size": "s', event_id % 5, '", "seats": ', event_id % 9, '}, "inclusions": ["i', event_id % 3, '", "lunch"],"""
        """ "exclusions": ["x', user_id % 3, '"], "faqs": [{"question": "q', event_id % 2, '", "answer": "a"}],"""
        """ "email": "e', user_id % 9, '@example.com"}')"""
    )
    return table(spark, folder, "events").selectExpr(
        "concat('img_', event_id) as image_id",
        "event_id as doc_id",
        "concat('Offer No ', event_id, case when event_id % 2 = 0 then '.pdf' else '.docx' end) as doc_name",
        f"""case event_id % 6 when 0 then {record}
            when 1 then concat('Here it is: ', {record}, ' Hope it helps.')
            when 2 then concat('Sure.\\n```json\\n', {record}, '\\n```\\nDone')
            when 3 then concat('{{"description": broken ', event_id)
            when 4 then concat('```\\n[1, ', {record}, ', {{"description": "second"}}]\\n```')
            end as response""",
        "case when event_id % 6 = 5 and event_id % 4 = 1 then 'timeout' end as error",
    )


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """Crawled pages as real ZIP files with the columns of a binaryFile scan."""
    return spread(table(spark, folder, "pages")).select("page_id", "url", "html").mapInPandas(
        pack_pages, "path string, length bigint, content binary"
    )


def pack_pages(batches):
    import io
    import zipfile

    import pandas as pd

    for batch in batches:
        paths, contents = [], []
        for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("site/page.html", html)
                archive.writestr("site/address.txt", url)
                archive.writestr("../outside.txt", "x")
                archive.writestr("site/empty.pdf", "")
            paths.append(f"uploads/page_{page_id}.zip")
            contents.append(buffer.getvalue())
        yield pd.DataFrame({"path": paths, "length": [len(c) for c in contents], "content": contents})
