"""Word lists and tables of the event domain; the order of entries breaks ties (first hit wins)."""

from __future__ import annotations


def _list(text: str) -> list[str]:
    return [w for line in text.strip().splitlines() for w in line.strip().split(" / ")]


def _pairs(text: str) -> list[tuple[str, str]]:
    return [(k, v) for k, v in (e.split("=", 1) for e in _list(text))]


TAIWAN_CITIES: list[str] = _list("""
    台北 / 新北 / 桃園 / 台中 / 台南 / 高雄 / 基隆 / 新竹 / 苗栗 / 彰化 / 南投 / 雲林 / 嘉義 / 屏東 / 宜蘭 / 花蓮 / 台東 / 澎湖 / 金門
    馬祖
""")

CITY_ALIASES: list[tuple[str, str]] = _pairs("""
    台北=台北 / 臺北=台北 / taipei=台北 / 台北市=台北 / 新北=新北 / 新北市=新北 / 板橋=新北 / 桃園=桃園 / 中壢=桃園 / taoyuan=桃園 / 台中=台中
    臺中=台中 / taichung=台中 / 西屯=台中 / 南屯=台中 / 台南=台南 / 臺南=台南 / tainan=台南 / 高雄=高雄 / kaohsiung=高雄 / 基隆=基隆
    新竹=新竹 / 苗栗=苗栗 / 彰化=彰化 / 南投=南投 / 雲林=雲林 / 嘉義=嘉義 / 屏東=屏東 / 宜蘭=宜蘭 / 花蓮=花蓮 / 台東=台東 / 臺東=台東 / 澎湖=澎湖
    金門=金門 / 馬祖=馬祖 / 連江=馬祖
""")

VENUE_CITY: list[tuple[str, str]] = _pairs("""
    華山1914=台北 / 松山文創=台北 / 松菸=台北 / 台北小巨蛋=台北 / 台北大巨蛋=台北 / 南港展覽館=台北 / 北流=台北 / 兩廳院=台北 / 國家音樂廳=台北 / 世貿=台北
    花博公園=台北 / 駁二=高雄 / 衛武營=高雄 / 高流=高雄 / 台中國家歌劇院=台中 / 科博館=台中 / 台南美術館=台南 / 奇美博物館=台南 / 蘭陽博物館=宜蘭
    傳藝中心=宜蘭
""")

TAIWAN_LANDMARKS: list[str] = _list("""
    華山 / 松菸 / 小巨蛋 / 大巨蛋 / 信義區 / 西門町 / 中正紀念堂 / 國父紀念館 / 兩廳院 / 南港展覽館 / 世貿 / 北流 / 北美館 / 當代館 / 大稻埕 / 迪化街
    圓山 / 花博 / 寶藏巖 / 美麗華 / 三創 / 光華 / 公館 / 師大 / 赤峰街 / 耶誕城 / 板橋車站 / 碧潭 / 淡水老街 / 漁人碼頭 / 九份 / 平溪 / 十分
    新月橋 / 435藝文特區 / 鶯歌 / 三峽老街 / 勤美 / 草悟道 / 審計新村 / 歌劇院 / 秋紅谷 / 科博館 / 逢甲 / 一中街 / 光復新村 / 綠園道 / 帝國製糖廠
    高美濕地 / 東海大學 / 藍晒圖 / 奇美博物館 / 南美館 / 漁光島 / 神農街 / 河樂廣場 / 安平古堡 / 赤崁樓 / 國華街 / 正興街 / 十鼓 / 駁二 / 衛武營 / 高流
    愛河 / 西子灣 / 棧貳庫 / 巨蛋 / 蓮池潭 / 大東 / 旗津 / 鐵花村 / 檜意森活村 / 傳藝中心 / 蘭陽博物館 / 羅東林業文化園區 / 勝利星村
""")

DISTRICT_COORDS: list[tuple[str, str]] = _pairs("""
    信義區=25.0328;121.5680 / 大安區=25.0260;121.5430 / 中正區=25.0326;121.5198 / 松山區=25.0571;121.5570
    萬華區=25.0260;121.4973 / 內湖區=25.0830;121.5750 / 士林區=25.0928;121.5246 / 文山區=24.9889;121.5703
""")

CITY_COORDS: list[tuple[str, str]] = _pairs("""
    台北=25.0330;121.5654 / 新北=24.9936;121.4617 / 桃園=24.9936;121.3010 / 台中=24.1477;120.6736
    台南=22.9999;120.2269 / 高雄=22.6273;120.3014 / 基隆=25.1276;121.7392 / 新竹=24.8138;120.9675
    苗栗=24.5602;120.8214 / 彰化=24.0796;120.5362 / 南投=23.9609;120.9718 / 雲林=23.7092;120.4313
    嘉義=23.4801;120.4491 / 屏東=22.6726;120.4871 / 宜蘭=24.7021;121.7377 / 花蓮=23.9872;121.6016
    台東=22.7583;121.1444
""")

EVENT_TYPES: list[str] = _list("""
    演唱會 / 音樂會 / 音樂節 / 展覽 / 特展 / 市集 / 夜市 / 講座 / 工作坊 / 舞台劇 / 音樂劇 / 脫口秀 / 相聲 / 魔術 / 馬戲 / 派對 / 路跑 / 馬拉松
    親子 / 電影 / 快閃店 / 見面會 / 簽書會 / 美食節 / 啤酒節 / 咖啡節 / 運動會 / 球賽 / 電競 / 寵物展 / 狗聚 / DJ / 電音 / 嘉年華 / 燈會 / 花火
    野餐 / 露營 / 健行 / 瑜珈 / 手作 / 體驗
""")

EVENT_TERMS: list[str] = _list("""
    活動 / 展覽 / 音樂 / 演唱會 / 市集 / 節慶 / 快閃店 / 見面會 / 簽書會 / 發表會 / 體驗會 / 生活節 / 音樂祭 / 派對 / 路跑 / 馬拉松
    festival / concert / exhibition / event / pop-up
""")

EVENT_TYPE_BOOST: list[tuple[str, str]] = _pairs("""
    演唱會=1.4 / 音樂會=1.3 / 音樂節=1.4 / 展覽=1.3 / 特展=1.3 / 快閃店=1.4 / 市集=1.3 / 生活節=1.3 / 講座=1.2 / 工作坊=1.2
    見面會=1.3 / 簽書會=1.2 / 親子=1.2 / 免費=1.1 / 美食節=1.3 / 啤酒節=1.3 / 咖啡節=1.2 / 電競=1.3 / 球賽=1.2 / 運動會=1.2
    寵物=1.2 / 毛小孩=1.2 / 派對=1.2 / 電音=1.2 / DJ=1.2 / 燈會=1.3 / 花火=1.3 / 煙火=1.3 / 野餐=1.2 / 露營=1.2
    嘉年華=1.3
""")

EVENT_TYPE_KEYWORDS: list[tuple[str, str]] = _pairs("""
    演唱會=演唱會 / concert=演唱會 / 音樂會=音樂會 / 音樂節=音樂節 / 展覽=展覽 / exhibition=展覽 / 市集=市集 / market=市集 / 講座=講座
    工作坊=工作坊 / 路跑=路跑 / 馬拉松=路跑 / 親子=親子活動 / 體驗=親子活動
""")

SYNONYMS: dict[str, list[str]] = {
    "演唱會": _list("""
        音樂會 / live / 演出
    """),
    "展覽": _list("""
        特展 / 展出 / 展示
    """),
    "市集": _list("""
        文創市集 / 假日市集 / market
    """),
    "音樂節": _list("""
        音樂祭 / festival
    """),
    "週末": _list("""
        假日 / 星期六 / 星期日
    """),
    "跨年": _list("""
        新年 / 元旦
    """),
}

CATEGORY_EXPANSIONS: dict[str, list[str]] = {
    "市集": _list("""
        文創市集 / 手作市集 / 假日市集 / 聖誕市集 / 二手市集 / 小農市集 / 餐車市集 / 風格市集 / 主題市集 / 復古市集 / 蚤之市 / 花市 / 創意市集 / 夜市
        market
    """),
    "展覽": _list("""
        特展 / 回顧展 / 快閃店 / 體驗展 / 藝術展 / 設計展 / 攝影展 / 插畫展 / 動漫展 / 博覽會 / 畢業展 / 個展 / 聯展 / 沉浸式展覽 / 互動展 / 光影展
        exhibition
    """),
    "音樂": _list("""
        音樂節 / 音樂祭 / live house / 聽團 / 樂團演出 / 獨立音樂 / 爵士音樂節 / 管弦樂 / 售票演唱會 / 免費演唱會 / 音樂會 / DJ派對 / 電音 / 嘻哈
        饒舌 / music festival
    """),
    "演唱會": _list("""
        巡迴演唱會 / 專場 / 見面會 / 粉絲見面會 / 售票演唱會 / 演唱會門票 / 小型演出 / acoustic / concert
    """),
    "親子": _list("""
        親子活動 / 體驗營 / 繪本 / 說故事 / 兒童劇 / DIY / 觀光工廠 / 科普活動 / 共融公園 / 親子館 / 夏令營 / 冬令營 / 兒童工作坊 / 親子手作 / 親子餐廳
    """),
    "戶外": _list("""
        露營 / 野餐 / 登山 / 健行 / 路跑 / 馬拉松 / 單車 / 自行車 / SUP / 衝浪 / 生態導覽 / 賞花 / 賞螢 / 賞楓 / 獨木舟 / 溯溪 / 攀岩 / 高空彈跳
    """),
    "藝文": _list("""
        講座 / 工作坊 / 座談會 / 分享會 / 讀書會 / 電影放映 / 影展 / 舞台劇 / 舞蹈 / 戲劇 / 表演藝術 / 脫口秀 / 相聲 / 音樂劇 / 現代舞 / 芭蕾
    """),
    "節慶": _list("""
        跨年 / 聖誕 / 過年 / 春節 / 元宵 / 燈會 / 萬聖節 / 情人節 / 嘉年華 / 祭典 / 煙火 / 花火節 / 啤酒節 / 週年慶
    """),
    "美食": _list("""
        美食節 / 餐酒會 / 品酒會 / 咖啡節 / 甜點節 / 火鍋節 / 啤酒節 / 小吃節 / 夜市美食 / 美食展 / 料理教室 / 烘焙課 / 品茗 / 下午茶 / brunch
    """),
    "運動": _list("""
        籃球 / 棒球 / 足球 / 電競 / 賽事 / 比賽 / 球賽 / 羽球 / 網球 / 桌球 / 排球 / 游泳 / 拳擊 / 格鬥 / 健身 / 瑜珈 / 有氧 / 重訓 / 運動會
    """),
    "寵物": _list("""
        毛小孩 / 狗聚 / 貓咪 / 寵物友善 / 寵物展 / 認養 / 寵物市集 / 毛孩 / 汪星人 / 喵星人 / 寵物野餐 / 狗狗運動會 / 寵物嘉年華
    """),
    "夜生活": _list("""
        夜店 / 酒吧 / 派對 / 電音 / clubbing / lounge / DJ night / ladies night / 主題派對 / 泳池派對 / rooftop / 調酒
    """),
    "文青": _list("""
        獨立書店 / 咖啡廳 / 選物店 / vintage / 古著 / 黑膠 / 底片 / 手沖咖啡 / 文創園區 / 藝術村 / 老屋 / 老宅 / 文化祭
    """),
    "潮流": _list("""
        潮牌 / 球鞋 / sneaker / 街頭 / 塗鴉 / 滑板 / 嘻哈 / 饒舌 / 街舞 / breaking / 潮流市集
    """),
}

NOISE_KEYWORDS: list[str] = _list("""
    碩士論文 / 博士論文 / 學位論文 / 研究生 / 指導教授 / 口試 / 摘要 / Abstract / 參考文獻 / 引用 / 文獻探討 / 研究方法 / 研究動機 / 研究目的
    關鍵詞 / Keywords / DOI / PDF下載 / 期刊 / 學報 / 專題製作 / 畢業製作 / 成果報告书 / 決算書 / 預算書 / 財報 / 報表 / 公告 / 標案
    決標 / 開標 / 會議記錄 / 公報 / 有線電視 / 第四台 / 寬頻 / 光纖 / 維修 / 客服 / 安裝 / 費率 / 繳費 / 徵才 / 職缺 / 招募 / 求職 / 人力銀行
    工讀 / 實習 / 新聞網 / 日報 / 快訊 / 社論 / 專欄
""")

FOREIGN_KEYWORDS: list[str] = _list("""
    東京 / 大阪 / 京都 / 北海道 / 首爾 / 釜山 / 曼谷 / 機票 / 入境 / 簽證
""")

EXCLUDED_DOMAINS: list[str] = _list("""
    x.com / twitter.com / ptt.cc / dcard.tw / amazon.co.jp / rakuten.co.jp / yahoo.co.jp
    booking.com / agoda.com / trivago.com / hotels.com / ndltd.ncl.edu.tw / airitilibrary.com
    scholar.google.com.tw
""")

SOCIAL_DOMAINS: list[str] = _list("""
    instagram.com / facebook.com / threads.net / fb.com
""")

APPLICATION_KEYWORDS: list[str] = _list("""
    申請 / 補助 / 辦法 / 要點 / 徵選 / 徵件 / 招標 / 採購 / 規定 / 須知 / 下載 / 表單
""")

PROPER_NOUNS: list[str] = _list("""
    華山 / 松菸 / 駁二 / 小巨蛋 / 大巨蛋 / 兩廳院 / 故宮 / 北美館 / 衛武營 / 高流 / 北流 / 科博館 / 奇美博物館 / 簡單生活節 / 大港開唱 / 春浪
    太魯閣峽谷音樂節 / 信義區 / 西門町 / 草悟道 / 勤美 / 審計新村
""")

AUTHORITY_DOMAINS: list[str] = _list("""
    travel.taipei / gov.tw
""")

STOP_WORDS: list[str] = _list("""
    的 / 了 / 在 / 是 / 我 / 有 / 和 / 就 / 不 / 人 / 都 / 一 / 一個 / 上 / 也 / 很 / 到 / 說 / 要 / 去 / 你 / 會 / 著 / 沒有
    看 / 好 / 自己 / 這 / 那 / 他 / 她 / 它 / 們 / 這個 / 那個 / 什麼 / 怎麼 / 可以 / 沒 / 把 / 讓 / 被 / 比 / 等 / 能 / 對 / 與
    及 / 或 / the / a / an / is / are / was / were / be / been / being / have / has / had / do / does
    did / will / would / could / should / may / might / must / shall / can / need / dare / to / of
    in / for / on / with / at / by / from / as / into / through / during / before / after / above
    below / and / but / or / nor / so / yet / both / either / neither / this / that / these / those
    i / you / he / she / it / we / they
""")

IMPORTANT_TERMS: list[str] = _list("""
    演唱會 / 音樂會 / 音樂節 / 展覽 / 特展 / 市集 / 夜市 / 講座 / 工作坊 / 派對 / 路跑 / 馬拉松 / 親子 / 免費 / 售票 / 票價 / 門票 / 報名
    活動 / 表演 / 演出 / concert / exhibition / festival / market / workshop / event
""")

PREDEFINED_WEIGHTS: list[tuple[str, str]] = _pairs("""
    活動=6.0 / 展覽=5.0 / 音樂=4.0 / 演唱會=4.0 / 市集=3.0 / 體驗=3.0 / 週末=2.0 / 假日=2.0 / 節慶=3.0 / festival=4.0
    concert=4.0 / exhibition=5.0 / event=6.0 / 戶外=3.0 / 免費=2.0 / 親子=3.0 / 藝術=4.0 / 表演=4.0
""")

RELATED_KEYWORDS: dict[str, list[str]] = {
    "音樂": _list("""
        演唱會 / live / 樂團 / 音樂節 / concert
    """),
    "展覽": _list("""
        美術 / 藝術 / 博物館 / gallery / 展出
    """),
    "市集": _list("""
        手作 / 文創 / 創意 / 攤位 / 市場
    """),
    "戶外": _list("""
        露營 / 健行 / 登山 / 野餐 / 運動
    """),
    "親子": _list("""
        兒童 / 家庭 / kids / 遊樂 / 體驗
    """),
    "節慶": _list("""
        慶典 / 嘉年華 / festival / 祭典 / 過年
    """),
    "表演": _list("""
        舞台 / 戲劇 / 舞蹈 / 劇場 / 演出
    """),
    "藝術": _list("""
        畫展 / 創作 / 設計 / 藝文 / 文化
    """),
}

WEEKDAY_MAP: list[tuple[str, str]] = _pairs("""
    週一=1 / 週二=2 / 週三=3 / 週四=4 / 週五=5 / 週六=6 / 週日=7 / 星期一=1 / 星期二=2 / 星期三=3 / 星期四=4 / 星期五=5 / 星期六=6
    星期日=7
""")

SKIP_EXTENSIONS: list[str] = _list("""
    .jpg / .jpeg / .png / .gif / .svg / .webp / .ico / .pdf / .doc / .docx / .xls / .xlsx / .ppt
    .pptx / .mp3 / .mp4 / .avi / .mov / .zip / .rar / .css / .js / .json
""")

SKIP_PATHS: list[str] = _list("""
    /login / /signup / /register / /auth / /cart / /checkout / /account / /admin / /api/ / /static/
    /assets/ / /privacy / /terms / /policy / /contact / /about
""")

CITY_SUGGESTIONS: dict[str, list[str]] = {
    "台北": _list("""
        台北展覽 / 台北市集 / 台北演唱會 / 信義區活動 / 華山活動 / 松菸展覽
    """),
    "新北": _list("""
        新北耶誕城 / 板橋活動 / 淡水活動 / 新北市集
    """),
    "台中": _list("""
        台中展覽 / 勤美活動 / 台中市集 / 台中演唱會
    """),
    "台南": _list("""
        台南古蹟 / 台南市集 / 藍晒圖活動 / 台南展覽
    """),
    "高雄": _list("""
        高雄展覽 / 駁二活動 / 高雄演唱會 / 衛武營活動
    """),
    "桃園": _list("""
        桃園展覽 / 中壢活動 / 華泰名品城
    """),
}

TYPE_SUGGESTIONS: dict[str, list[str]] = {
    "市集": _list("""
        聖誕市集 / 文創市集 / 假日市集 / 手作市集 / 夜市
    """),
    "展覽": _list("""
        免費展覽 / 藝術展 / 攝影展 / 互動展覽 / 博物館
    """),
    "音樂": _list("""
        演唱會 / 音樂節 / live house / 免費演唱會
    """),
    "演唱會": _list("""
        跨年演唱會 / 演唱會門票 / 小巨蛋演唱會
    """),
    "親子": _list("""
        親子展覽 / 兒童活動 / 親子餐廳 / 親子市集 / 親子DIY
    """),
    "戶外": _list("""
        露營活動 / 登山活動 / 野餐活動 / 路跑活動
    """),
    "畫展": _list("""
        免費畫展 / 藝術展覽 / 美術館展覽 / 當代藝術展
    """),
    "棒球": _list("""
        棒球比賽 / 棒球賽程 / 棒球直播 / 棒球今天 / 棒球台灣
    """),
}

TIME_SUGGESTIONS: list[str] = _list("""
    週末活動 / 今天活動 / 本週活動 / 免費活動 / 跨年活動
""")

HOT_SUGGESTIONS: list[str] = _list("""
    聖誕市集 / 跨年演唱會 / 免費展覽 / 親子活動 / 戶外活動 / 台北展覽 / 週末市集 / 音樂節
""")

DERIVED_EVENT_WORDS: list[str] = _list("""
    市集 / 展覽 / 演唱會 / 音樂節 / 活動 / 演出 / 表演 / 工作坊 / 講座 / 派對 / 路跑 / 野餐 / 手作 / 文創 / 聖誕 / 跨年 / 春節 / 萬聖節 / 燈會
    花火
""")

QUERY_SUFFIXES: list[str] = _list("""
    市集 / 展覽 / 活動 / 節 / 祭 / 日
""")

DERIVED_PLACE_WORDS: list[str] = _list("""
    華山 / 松菸 / 駁二 / 信義 / 大安 / 中山 / 西門 / 台北 / 新北 / 台中 / 高雄 / 台南
""")

REFINE_PLACE_WORDS: list[str] = _list("""
    信義 / 大安 / 中山 / 松山 / 內湖 / 士林 / 北投 / 萬華 / 中正 / 大同 / 板橋 / 新店 / 中和 / 永和 / 三重 / 淡水 / 西門 / 東區 / 天母
    台北 / 新北 / 台中 / 高雄 / 台南 / 桃園 / 華山 / 松菸 / 駁二 / 草悟道 / 逢甲 / 一中
""")

CATEGORIES: list[tuple[str, str, str, str]] = [  # id, name and request, icon, colour
    ("market", "市集", "🛍️", "#FF6B6B"), ("art", "展覽", "🎨", "#4ECDC4"), ("concert", "演唱會", "🎤", "#95E1D3"), ("festival", "音樂節", "🎵", "#F38181"),
    ("lecture", "講座", "📚", "#AA96DA"), ("workshop", "工作坊", "🛠️", "#FCBAD3"), ("family", "親子", "👨‍👩‍👧‍👦", "#FFFFD2"), ("outdoor", "戶外", "🏕️", "#A8D8EA"),
    ("food", "美食", "🍜", "#FFD93D"), ("sports", "運動", "⚽", "#6BCB77"), ("pet", "寵物", "🐾", "#FDA7DF"), ("celebration", "節慶", "🎊", "#E4A5FF"),
]

CITY_NAMES: list[tuple[str, str]] = _pairs("""
    Taipei=台北 / New Taipei=新北 / Taoyuan=桃園 / Taichung=台中 / Tainan=台南 / Kaohsiung=高雄 / Keelung=基隆 / Hsinchu=新竹
    타이베이=台北 / 신베이=新北 / 타오위안=桃園 / 타이중=台中
""")
