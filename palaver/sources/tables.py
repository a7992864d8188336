"""Parquet tables as messages(room_id, line, ts, sender, message).

Each view exists twice: as a DataFrame for Spark and as plain SQL for the engine
that checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def event_messages(spark: SparkSession, folder: str, by_type: bool = True) -> DataFrame:
    """The events stream as chat: one room per event type, or a single busy room."""
    room = F.col("event_type") if by_type else F.lit("events")
    return table(spark, folder, "events").select(
        room.alias("room_id"), F.col("event_id").alias("line"), "ts",
        F.col("user_id").cast("string").alias("sender"), F.col("event_type").alias("message"),
    )


def event_messages_sql(by_type: bool = True) -> str:
    room = "event_type" if by_type else "'events'"
    return (
        f"select {room} as room_id, event_id as line, ts, cast(user_id as varchar) as sender, "
        "event_type as message from events"
    )


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Many small rooms with three senders."""
    seconds = (F.col("conv_id") * 3600 + F.col("turn") * 45).cast("int")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("room_id"), F.col("turn").alias("line"),
        F.timestamp_add("SECOND", seconds, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.col("role").alias("sender"), F.col("text").alias("message"),
    )


CONVERSATIONS_SQL = (
    "select cast(conv_id as varchar) as room_id, turn as line, "
    "timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 45) as ts, "
    "role as sender, text as message from conversations"
)


def document_messages(spark: SparkSession, folder: str, room: str = "source") -> DataFrame:
    """Long texts: one room per source (or language), spread over 90 days."""
    hours = ((F.col("doc_id") % 2160) * 3600).cast("int")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs, "doc_id").select(
        F.col(room).alias("room_id"), F.col("doc_id").alias("line"),
        F.timestamp_add("SECOND", hours, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.col("lang").alias("sender"), F.col("text").alias("message"),
    )


def documents_sql(room: str = "source") -> str:
    return (
        f"select {room} as room_id, doc_id as line, "
        "timestamp '2024-01-01 00:00:00' + to_seconds((doc_id % 2160) * 3600) as ts, "
        "lang as sender, text as message from documents"
    )


# Sentences of an imagined Korean room. A row of ``events`` picks one by its id and
# fills in its user and id, so the text volume grows with the table.
SENTENCES = (
    "안녕하세요 {u}님 반가워요",
    "user{u}님이 들어왔습니다.",
    "오늘 회의 내일 오전 10:30 맞나요?",
    "ㅋㅋㅋㅋ",
    "좋아요 최고 👍",
    "사진",
    "https://www.example.com/p/{n} 여기 보세요",
    "user{u}님이 나갔습니다.",
    "이 파일 공유 부탁드립니다",
    "배포 자동화 서버 설정 완료했습니다",
    "넵",
    "메시지가 삭제되었습니다.",
    "서버 설정 문제 때문에 힘들어 😢",
    "샵검색: #맛집{u}",
    "다음 주 점심 뭐 먹지?",
    "사진 3장",
    "배포 자동화 일정 확인해 주세요 #배포 #일정",
    "관리자가 메시지를 가렸습니다.",
    "user{u}님을 내보냈습니다.",
    "ㅎㅎ 대박 😂😂",
    "데이터 파이프라인 배포 자동화 너무 어렵다",
    "관리자만 말하기 기능이 활성화되었습니다.",
    "user{u}님이 부방장이 되었습니다.",
    "진짜 짜증 시발",
    "메일은 user{u}@example.com 입니다 번호 1234567{u}",
    "관리자만 말하기 기능이 해제되었습니다.",
    "클로드 코드 리뷰 도구 추천 #클로드",
    "user{u}님이 방장이 되었습니다.",
    "저녁에 동영상 보자 ❤️",
    "반가워! 닉 옆에 정치성향 적어 주세요 규칙 꼭 읽어 주세요",
    "샵검색",
    "그건 아니지",
    "정말 잘했어요 축하드려요 🎉",
    "답장 늦어서 죄송합니다\n관리자가 메시지를 가렸습니다.",
    "user{u}님이 선물과 메시지를 보냈습니다.",
    "데이터 파이프라인 테스트 결과 공유합니다\n두번째 줄 설명",
    "ㅇㅇ",
    "프롬프트 작성 도구 Claude 그리고 Cursor 사용해요",
    "www.sample.org/docs 와 https://news.example.net:8080/a?x=1 참고",
    "테스트 서버 배포합니다. 문제 있으면 말씀하세요",
    "샵검색 커피",
    "밤에 자꾸 깨서 우울해",
    "새벽까지 코딩해서 피곤하다",
)


def _quoted(text: str, newline: str) -> str:
    return "'" + text.replace("\n", newline) + "'"


def _pick_sql(newline_sql: str, text_type: str) -> str:
    cases = " ".join(
        "when {} then {}".format(
            i, " || {} || ".format(newline_sql).join("'" + part + "'" for part in s.split("\n"))
        )
        for i, s in enumerate(SENTENCES)
    )
    n = len(SENTENCES)
    return (
        f"replace(replace(case (event_id * 7 + user_id) % {n} {cases} end, "
        f"'{{u}}', cast(user_id as {text_type})), '{{n}}', cast(event_id as {text_type}))"
    )


def chat_messages(spark: SparkSession, folder: str, by_type: bool = True) -> DataFrame:
    """Events with Korean message texts (notices, links, reactions, keywords)."""
    base = spread(table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type"), "event_id", narrow=True)
    room = "event_type" if by_type else "'chat'"
    return base.selectExpr(
        f"{room} as room_id", "event_id as line", "ts",
        "concat('user', cast(user_id as string)) as sender", f"{_pick_sql('char(10)', 'string')} as message",
    )


def chat_sql(by_type: bool = True) -> str:
    room = "event_type" if by_type else "'chat'"
    return (
        f"select {room} as room_id, event_id as line, ts, 'user' || cast(user_id as varchar) as sender, "
        f"{_pick_sql('chr(10)', 'varchar')} as message from events"
    )


def order_days(spark: SparkSession, folder: str) -> DataFrame:
    """A long daily series: orders per day, one room per priority."""
    return table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("room_id"), F.to_date("o_orderdate").alias("day")
    ).agg(F.count("*").alias("messages"))


ORDER_DAYS_SQL = (
    "select o_orderpriority as room_id, cast(o_orderdate as date) as day, count(*) as messages "
    "from orders group by 1, 2"
)


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs as messages that consist of one link; room is the site language."""
    return table(spark, folder, "pages").select(
        F.lit("pages").alias("room_id"), F.col("page_id").alias("line"), F.col("url").alias("message"),
    )
