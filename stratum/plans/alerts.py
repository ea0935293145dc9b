"""Alert channels. A channel is a callable of (title, content); one that fails does not stop the others."""

from __future__ import annotations

import json
import logging
import os
import smtplib
import urllib.request
from collections.abc import Callable
from email.mime.text import MIMEText

Channel = Callable[[str, str], None]
logger = logging.getLogger(__name__)


class Alerts:
    def __init__(self) -> None:
        self.channels: list[Channel] = []

    def register(self, channel: Channel) -> None:
        self.channels.append(channel)

    def send(self, title: str, content: str) -> int:
        """Give the alert to all channels; the number that took it."""
        done = 0
        for channel in self.channels:
            try:
                channel(title, content)
                done += 1
            except Exception:
                logger.exception("alert channel failed")
        return done

    def register_from_environment(self, env: dict[str, str] | None = None) -> Alerts:
        """Webhook channels for WECOM_WEBHOOK_URL and FEISHU_WEBHOOK_URL, mail for SMTP_HOST."""
        env = dict(os.environ) if env is None else env
        if url := env.get("WECOM_WEBHOOK_URL"):
            self.register(lambda title, content: post_json(url, {"msgtype": "markdown", "markdown": {"content": f"## {title}\n{content}"}}))
        if hook := env.get("FEISHU_WEBHOOK_URL"):
            self.register(lambda title, content: post_json(hook, {"msg_type": "text", "content": {"text": f"{title}\n{content}"}}))
        if env.get("SMTP_HOST"):
            self.register(lambda title, content: send_mail(env, title, content))
        return self


def without_query(url: str) -> str:
    """The address as it may be logged."""
    return url.split("?", 1)[0]


def post_json(url: str, payload: dict, timeout: float = 10) -> None:
    logger.info("posting to %s", without_query(url))
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout):
        pass


def send_mail(env: dict[str, str], title: str, content: str) -> None:
    """One message by SMTP: TLS from the start on port 465, else STARTTLS."""
    message = MIMEText(content, "plain", "utf-8")
    message["Subject"], message["From"], message["To"] = title, env.get("SMTP_FROM", env.get("SMTP_USER", "")), env.get("SMTP_TO", "")
    port = int(env.get("SMTP_PORT", "465"))
    server = smtplib.SMTP_SSL(env["SMTP_HOST"], port, timeout=10) if port == 465 else smtplib.SMTP(env["SMTP_HOST"], port, timeout=10)
    with server:
        if port != 465:
            server.starttls()
        if env.get("SMTP_USER"):
            server.login(env["SMTP_USER"], env.get("SMTP_PASSWORD", ""))
        server.sendmail(message["From"], message["To"].split(","), message.as_string())
