"""Values that stored data and displayed text depend on."""

# They have to stay exactly as they are for results to match.
SOURCE_CATALOGUE = "ML"
SOURCE_FEED = "TMDB"
ALGORITHM = "ALS"
NO_GENRES = "(no genres listed)"
TITLE_YEAR_PATTERN = r"\((\d{4})\)\s*$"
ACCOUNT_PREFIX = "ml_user_"
DISPLAY_NAME_PREFIX = "MovieLens User "
ANONYMOUS_NAME = "匿名用户"
REASON_BEFORE = "基于您的观影偏好推荐（算法："
REASON_AFTER = "）"
NO_AVERAGE_STATS = "0.0"
NO_AVERAGE_LABEL = "暂无"
POSTER_BASE = "https://image.tmdb.org/t/p/w500"
DIRECTOR_JOB = "Director"
CAST_SHOWN = 5
RATING_MIN = 1.0
RATING_MAX = 5.0

# The ten rows every new catalogue starts with
# (id, title, genres, year, description, avgRating, ratingCount).
SEED_MOVIES = [
    (1, "肖申克的救赎", "剧情|犯罪", 1994, "一个关于希望和自由的故事", "4.8", 1500),
    (2, "霸王别姬", "剧情|爱情", 1993, "两位京剧伶人半个世纪的悲欢离合", "4.7", 1200),
    (3, "这个杀手不太冷", "剧情|动作|犯罪", 1994, "一个杀手和一个小女孩的故事", "4.6", 1100),
    (4, "阿甘正传", "剧情|爱情", 1994, "智商75的阿甘创造的传奇人生", "4.5", 1000),
    (5, "盗梦空间", "动作|科幻|悬疑", 2010, "梦境中的盗窃行动", "4.4", 950),
    (6, "星际穿越", "科幻|冒险", 2014, "穿越虫洞寻找新家园", "4.5", 900),
    (7, "楚门的世界", "剧情|科幻", 1998, "一个人的真实人生其实是一场真人秀", "4.3", 850),
    (8, "海上钢琴师", "剧情|音乐", 1998, "一个从未踏上陆地的钢琴天才", "4.6", 800),
    (9, "三傻大闹宝莱坞", "剧情|喜剧", 2009, "印度教育制度的讽刺喜剧", "4.4", 750),
    (10, "放牛班的春天", "剧情|音乐", 2004, "一个代课老师改变孩子们的人生", "4.3", 700),
]
